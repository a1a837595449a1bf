"""Quality classifier by pairwise ranking (Bradley-Terry).

Features of whole texts are put on one scale by means and deviations over all documents.  Weights come from
preference pairs (a document of label 1 over one of label 0) by logistic loss on the difference of their
features; the threshold is a quantile of the scores of all learning documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, remainder, ship, space_rule, text_buffers, word_hashes, written

ship(__name__)

#: Bounds of the sample that pairs are drawn from: documents per label, and pairs.
SAMPLE_PER_LABEL, PAIRS = 2000, 20000
THRESHOLD = 0.7
LEVELS = 200
RIDGE = 1e-3
#: Byte classes whose shares are features; a byte in no class counts as other.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
           "stop": b".,;:", "mark": b"!?", "bar": b"|", "symbol": b"#*$%&<>@^~=+_", "quote": b"\"'()[]{}", "wide": range(128, 256)}
FEATURES = [*CLASSES, "log_length", "caps_share", "word_length", "log_words", "distinct_words", "next_word_same",
            "top_word", "distinct_triples", "line_words", "dup_lines"]


def class_table():
    out = np.full(256, len(CLASSES), np.uint8)
    for i, which in enumerate(CLASSES.values()):
        out[list(which)] = i
    return out


def text_features(column) -> np.ndarray:
    """One row of FEATURES per text of an Arrow string array, over whole texts; a null is an empty text."""
    data, offsets = text_buffers(column)
    words, at = word_hashes(data, offsets, space_rule())
    table, k = class_table(), len(CLASSES)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i in range(len(offsets) - 1):
        b = data[offsets[i]:offsets[i + 1]]
        if not len(b):
            continue
        n = np.bincount(table[b], minlength=k + 1)
        out[i, :k] = n[:k] / len(b)
        h = words[at[i]:at[i + 1]]
        letters = n[0] + n[1]
        out[i, k:k + 2] = math.log1p(len(b)), n[0] / letters if letters else 0.0
        if len(h):
            _, seen = np.unique(h, return_counts=True)
            three = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else h
            lines = bytes(b).split(b"\n")
            lines = [x for x in lines if x.strip()]
            out[i, k + 2:] = ((len(b) - n[3] - n[4]) / len(h), math.log1p(len(h)), len(seen) / len(h),
                              float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0, seen.max() / len(h),
                              len(np.unique(three)) / len(three), math.log1p(len(h) / (n[4] + 1)),
                              1 - len(set(lines)) / len(lines) if lines else 0.0)
    return out


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one double per feature, written once: map-only."""
    def run(batches):
        import pyarrow as pa
        for b in pieces(batches, 1):
            x = text_features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["doc_id", *FEATURES])
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{f} double" for f in FEATURES]])), "features")


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, steps: int = 30) -> np.ndarray:
    """Weights that make sigma(w . (good - bad)) likely over preference pairs: Newton steps on the logistic loss."""
    if not len(good) or not len(bad):
        return np.zeros(good.shape[1] if good.ndim == 2 else 0)
    rng = np.random.default_rng(11)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from label rows whose crc32 of the id modulo 4 is not 2.  Null labels and ids are not learnt from; a
    document with several label rows counts once per row.  Null and empty texts have all features 0 and are
    scored.  Without both labels all scores are the threshold.  Empty table: no rows.  Other columns are not read.
    """
    table = feature_table(docs, doc_id, text)
    stats = table.agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    mean = {f: stats[f"m_{f}"] or 0.0 for f in FEATURES}
    dev = {f: stats[f"s_{f}"] or 1.0 for f in FEATURES}
    scaled = table.select("doc_id", *[F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(f) - mean[f]) / dev[f])).alias(f) for f in FEATURES])
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).filter(F.col("_label").isNotNull() & (remainder("_id", 4) != 2))
    learn = written(scaled.join(marks, F.col("doc_id") == F.col("_id")).drop("_id"), "learn")
    few = {}
    for v in (0, 1):
        rows = learn.filter(F.col("_label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL).select(*FEATURES).collect()
        few[v] = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(FEATURES))
    w = fit_pairs(few[1], few[0])
    raw = sum((F.col(f) * F.lit(float(x)) for f, x in zip(FEATURES, w)), F.lit(0.0))
    cut, slope = threshold(learn.select(raw.alias("s"), F.col("_label").alias("y")), few, w)
    shift = math.log(THRESHOLD / (1 - THRESHOLD))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-((raw - F.lit(cut)) * F.lit(slope) + F.lit(shift))))
    out = scaled.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def threshold(scores: DataFrame, few, w) -> tuple[float, float]:
    """(score at the quantile that best parts the labels, slope of the score): over all learning rows.

    Of LEVELS quantiles, the first with the best balanced accuracy; the cut lies midway to the quantile below it.
    """
    if not len(few[0]) or not len(few[1]):
        return 0.0, 1.0
    levels = scores.agg(F.percentile_approx("s", F.array(*[F.lit((i + 0.5) / LEVELS) for i in range(LEVELS)]), 20000)).first()[0]
    edges = sorted(set(levels))
    below = scores.groupBy("y").agg(F.count(F.lit(1)), *[F.sum((F.col("s") < e).cast("long")) for e in edges]).collect()
    share = {r[0]: np.array(r[2:], float) / max(1, r[1]) for r in below}
    gain = share.get(0, 0) - share.get(1, 0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    cut = (float(edges[best[0]]) + float(edges[max(0, best[0] - 1)])) / 2
    raw = np.concatenate([few[0] @ w, few[1] @ w])
    return cut, 4.0 / float(np.std(raw) or 1.0)
