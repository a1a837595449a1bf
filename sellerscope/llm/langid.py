"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters of the whole text (other signs count as one
space), with logarithmic counts, inverse document frequencies over all training rows, and unit length.
Weights are learnt by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
rows; a temperature fitted on rows of the sample that training did not see calibrates the scores.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, ship

ship(__name__)

BITS = 15
BUCKETS = 1 << BITS
#: Bounds of the labelled sample that the weights are learnt from: rows per language, and rows in all.
SAMPLE_PER_LANG, SAMPLE_ROWS = 800, 4000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.002, 0.002
PIECE = 1 << 20
#: Texts of so many grams (about 200 letters) and more are rejected below SLACK times the least score that any such text of
#: the sample's held rows gets; shorter ones below SLACK times the least that a beginning of their size of a held row gets.
LONG, SLACK = 600, 0.9
#: Signs of those beginnings: 1 to about 600 grams, at least one for each power of two.
STARTS = (1, 2, 3, 5, 8, 16, 32, 64, 128, 190)
UNKNOWN = "und"


def letter_table():
    """code point -> is a letter, for the planes that hold letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x32000)), bool, 0x32000)


def gram_counts(text: str, letters) -> np.ndarray | None:
    """Counts per hash bucket of the 1- to 3-grams of a whole text; None where it has no letter.

    The text is worked through in pieces; the last two kept signs go over to the next one, and each gram counts in
    the piece that it ends in."""
    total, tail, after_letter, text = None, np.zeros(0, np.uint32), False, text.lower()
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[np.minimum(c, len(letters) - 1)] & (c < len(letters))
        keep = is_letter | np.concatenate(([after_letter], is_letter[:-1]))
        after_letter = bool(is_letter[-1])
        c = np.concatenate((tail, np.where(is_letter, c, np.uint32(32))[keep]))
        old, tail = len(tail), c[-2:]
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        ends = (one[old:], two[max(0, old - 1):], three[max(0, old - 2):])
        grams = [(g ^ (g >> np.uint32(13))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS) for g in ends]
        counts = np.bincount(np.concatenate(grams), minlength=BUCKETS)
        total = counts if total is None else total + counts
    return total if total is not None and total.any() else None


def unit_features(counts, idf):
    """(buckets, values): log counts times idf, of unit length."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]).astype(np.float32) * idf[at]
    return at, x / np.float32(math.sqrt(float(x @ x)) or 1.0)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(rows with a letter, rows per bucket) over all rows of ``texts``; a task sends one row per bucket it met."""
    def count(batches):
        import pyarrow as pa
        letters, df, n = letter_table(), np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                counts = gram_counts(t, letters) if t else None
                if counts is not None:
                    df[:BUCKETS] += counts > 0
                    df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["bucket", "n"])
    rows = (texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r.bucket] = r.n
    return int(df[BUCKETS]), df[:BUCKETS]


def labelled_sample(rows: DataFrame) -> list:
    """Up to SAMPLE_ROWS (lang, buckets, counts) of ``rows`` (doc_id, text, lang).

    A row is taken where the hash of its id lies below its language's share, set so that about SAMPLE_PER_LANG
    rows of each are (all of a rare one): counts are all that is gathered per language.
    """
    h = F.xxhash64("doc_id")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    per = max(20, min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, len(counts))))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, per / r.n))).otherwise(share)
    some = rows.select("lang", h.alias("h"), "text").filter(F.col("h").cast("double") / 2.0 ** 64 + 0.5 <= share)

    def features(batches):
        import pyarrow as pa
        letters = letter_table()
        for b in batches:
            out = []
            for lang, hh, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts = gram_counts(t, letters) if t else None
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((lang, hh, at.astype(np.uint16).tobytes(), counts[at].astype(np.int64).tobytes(), t[:STARTS[-1]]))
            cols = list(zip(*out)) if out else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())],
                                             ["lang", "h", "at", "n", "start"])
    return (some.mapInArrow(features, "lang string, h long, at binary, n binary, start string")
            .orderBy("h", "lang", "at", "n", "start").limit(SAMPLE_ROWS).collect())


def ftrl(examples, classes: int, epochs: int = EPOCHS):
    """Per-coordinate FTRL-proximal with L1 and L2 on (buckets, values, class); returns (weights, bias)."""
    z, n = np.zeros((BUCKETS + 1, classes), np.float32), np.zeros((BUCKETS + 1, classes), np.float32)

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, np.float32(0), w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            at, x = np.append(at, BUCKETS), np.append(x, np.float32(1))
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :].astype(np.float32)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def temperature(scores, y) -> float:
    """The divisor of the scores that gives the held examples the least log loss.

    One more example, spread over all classes, is counted in: without an error among few examples scores aren't
    taken for certain.
    """
    if not len(y):
        return 1.0
    spread = 1.0 / (len(y) + 1)

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        logp = s - np.log(np.exp(s).sum(axis=1))[:, None]
        return float(-((1 - spread) * logp[np.arange(len(y)), y].mean() + spread * logp.mean()))
    grid = np.exp(np.linspace(math.log(0.02), math.log(20), 120))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


class Model(SimpleNamespace):
    """langs, idf, weights, bias, temp, floor (the least score that a long text of a learnt language can be expected to get),
    short (the same of shorter texts: place k is for those whose number of grams has k bits)."""


def fit_languages(rows: DataFrame) -> Model:
    """A model from (doc_id, text, lang); rows without a text or language are left out."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    docs, df = document_frequencies(rows.select("text"))
    idf = (np.log((1.0 + docs) / (1.0 + df)) + 1.0).astype(np.float32)
    sample = labelled_sample(rows)
    langs = sorted({r.lang for r in sample})
    no = {x: i for i, x in enumerate(langs)}
    examples, sizes = [], []
    for r in sample:
        counts = np.zeros(BUCKETS, np.int64)
        counts[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.int64)
        examples.append((*unit_features(counts, idf), no[r.lang]))
        sizes.append(int(counts.sum()))
    held, learn = examples[::5], [x for i, x in enumerate(examples) if i % 5]
    w, b = ftrl(learn or examples, max(1, len(langs)))
    scores = np.array([x @ w[at] + b for at, x, _ in held]).reshape(len(held), max(1, len(langs)))
    temp = temperature(scores, np.array([y for _, _, y in held], int))
    m = Model(langs=langs, idf=idf, weights=w, bias=b, temp=temp)
    m.floor = SLACK * min((identified(s, m)[1] for s, n in zip(scores, sizes[::5]) if n >= LONG), default=0.0)
    m.short = short_limits([r.start for r in sample[::5]], m)
    return m


def short_limits(starts, m) -> list:
    """The least scores of texts below LONG grams by the bits of that number, from the beginnings of held texts.

    No size is held to more than a longer one.  A size that no beginning has: 0, so nothing is rejected."""
    letters, least = letter_table(), np.full(LONG.bit_length() + 1, np.inf)
    for text in starts:
        for n in STARTS:
            counts = gram_counts(text[:n], letters)
            size = 0 if counts is None else int(counts.sum())
            if 0 < size < LONG:
                least[size.bit_length()] = min(least[size.bit_length()], language(counts, m)[1])
    upto = np.minimum.accumulate(np.append(SLACK * least, m.floor or np.inf)[::-1])[::-1][:-1]
    return np.where(np.isinf(least), 0.0, upto).tolist()


def identified(scores, m) -> tuple[str, float]:
    """(the likeliest language, its probability) of a text's scores."""
    s = scores / m.temp
    p = np.exp(s - s.max())
    return m.langs[int(p.argmax())], float(p.max() / p.sum())


def language(counts, m) -> tuple[str, float]:
    """The same of a text's grams; `und` and 0 where there is no letter or no learnt language."""
    if counts is None or not m.langs:
        return UNKNOWN, 0.0
    at, x = unit_features(counts, m.idf)
    return identified(x @ m.weights[at] + m.bias, m)


def least_score(counts, m) -> float:
    """The score below which a text of so many grams is taken for none of a learnt language."""
    size = int(counts.sum())
    return m.floor if size >= LONG else m.short[size.bit_length()]


def predict_languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row: map-only, on whole texts; `und` and 0 for null or letterless texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # buckets x languages

    def predict(batches):
        import pyarrow as pa
        m, letters = SimpleNamespace(**shared.value), letter_table()
        for b in batches:
            pred, score = [], []
            for t in b.column(1).to_pylist():
                lang, p = language(gram_counts(t, letters) if t and m.langs else None, m)
                pred.append(lang)
                score.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, text, lang) of the rows whose crc32 of the id modulo 5 is not 0."""
    return docs.filter(remainder(doc_id, 5) != 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null or empty text, or one without a letter: `und` with score 0.  Very long texts are counted whole.  Null language: not learnt from.  Null id:
    predicted, not learnt from, held_out null.  Repeated rows: predicted alike.  No labelled row: all `und`.
    Empty table: no rows.  Other columns are not read.
    """
    out = predict_languages(docs, fit_languages(training_rows(docs)))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """The rows (with columns doc_id, text, lang) whose language is identified; columns unchanged.

    The language of every text with a letter is identified.  Rejected are rows without a letter (null and empty text
    too), and texts with a score below ``min_score``: unless given, nine tenths of the least score that a text of their
    size gets, a long one among the sample's held rows or a beginning of one of these.  So texts of letters in no learnt
    language go and clean texts stay; the shorter a text, the less its score must be.  Very long texts are judged whole.
    Repeated rows are judged alike.  No labelled row: all go.  Empty table: no rows.  Scores travel with the text:
    nothing is joined or shuffled.
    """
    model = fit_languages(training_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa
        m, letters = SimpleNamespace(**shared.value), letter_table()
        for b in batches:
            ok = []
            for t in b.column(at).to_pylist():
                counts = gram_counts(t, letters) if t and m.langs else None
                _, score = language(counts, m)
                ok.append(counts is not None and score >= (least_score(counts, m) if min_score is None else min_score))
            yield b.filter(pa.array(ok, pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)
