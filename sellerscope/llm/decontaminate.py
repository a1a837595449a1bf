"""Benchmark decontamination with suffix arrays over the training documents.

Each batch of documents is a shard.  Its words become numbers of the benchmark's vocabulary, and the suffixes
that a benchmark window can start (so many words of the vocabulary in a row) are sorted into the shard's suffix
array.  Every benchmark suffix is binary-searched in every shard; its interval gives the places of its window,
and word-by-word extension the longest verbatim matches.  Hit words are those that the longest matches cover.

The benchmark is cut into blocks by the tasks that read it; a block is a file in the shared folder.  Tasks over
documents load the blocks one after the other and keep up to CACHE_BYTES of them, so neither the driver nor a
worker ever holds the whole benchmark.
"""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, open_fs, pieces, plain_rule, shared_path, ship, text_buffers, word_hashes, worker_state, written

ship(__name__)

WINDOW = 10
#: Benchmark text is searched in blocks of at most so many bytes (one item may exceed it).
BLOCK_BYTES = 4 << 20
#: Bytes of loaded blocks that a worker keeps, and pairs of places that are extended at a time.
CACHE_BYTES, PAIRS = 192 << 20, 1 << 20

def item_block(ids: list, texts: list) -> dict:
    """Vocabulary (sorted word hashes), the items' words as numbers from 1, and the distinct windows with their places.

    ``keys``/``lengths``: each distinct window, padded with zeros to WINDOW; ``first``/``places``: its suffixes as
    (item, place) by window.
    """
    import pyarrow as pa
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    words, at = word_hashes(data, offsets, plain_rule())
    vocab = np.unique(words)
    no = (np.searchsorted(vocab, words) + 1).astype(np.int32)
    rows, item, place = [], [], []
    for i in range(len(texts)):
        n = int(at[i + 1] - at[i])
        w = min(WINDOW, n)
        for j in range(n - w + 1 if n else 0):
            rows.append(np.pad(no[at[i] + j:at[i] + j + w], (0, WINDOW - w)))
            item.append(i)
            place.append(j)
    grid = np.array(rows, np.int32).reshape(len(rows), WINDOW)
    wins, back = np.unique(grid, axis=0, return_inverse=True) if len(rows) else (grid, np.zeros(0, int))
    back = np.asarray(back).reshape(-1)
    order = np.argsort(back, kind="stable")
    return {"ids": list(ids), "vocab": vocab, "no": no, "at": at, "wins": wins, "lengths": (wins > 0).sum(axis=1),
            "first": np.searchsorted(back[order], np.arange(len(wins) + 1)),
            "item": np.array(item, np.int64)[order], "place": np.array(place, np.int64)[order]}


def numbers(words, vocab):
    """Vocabulary numbers (from 1) of word hashes; 0 for words outside it."""
    out = np.zeros(len(words), np.int32)
    if len(vocab):
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocab >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(words >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(vocab, words[some]), len(vocab) - 1)
        out[some] = np.where(vocab[spot] == words[some], spot + 1, 0)
    return out


def keys_of(grid):
    """Rows of word numbers as byte strings whose order is that of the rows."""
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * WINDOW}").reshape(-1)


def suffix_array(no, at, least: int):
    """(places, keys) of the shard's suffixes that begin with at least ``least`` vocabulary words, in order of their first WINDOW words."""
    # a suffix's run of vocabulary words ends at the next gap or at its document's end; a mark at its own place is no end
    ends = np.unique(np.concatenate([np.flatnonzero(no == 0), at[1:]]))
    here = np.flatnonzero(no > 0)
    run = ends[np.searchsorted(ends, here, "right")] - here if len(here) else here
    here, run = here[run >= least], run[run >= least]
    cols = np.arange(WINDOW)
    grid = np.zeros((len(here), WINDOW), np.int32)
    inside = cols[None, :] < run[:, None]
    grid[inside] = no[(here[:, None] + cols[None, :])[inside]]
    keys = keys_of(grid)
    order = np.argsort(keys, kind="stable")
    return here[order], keys[order]


def intervals(keys, block):
    """[low, high) in the suffix array of each distinct benchmark window, by binary search."""
    wins, lengths = block["wins"], block["lengths"]
    top = wins.copy()
    top[np.arange(WINDOW)[None, :] >= lengths[:, None]] = np.iinfo(np.int32).max
    return np.searchsorted(keys, keys_of(wins), "left"), np.searchsorted(keys, keys_of(top), "right")


def search_block(words, at, block):
    """(window's place, window, word numbers) of one shard and one block; every place of every window."""
    least = int(block["lengths"].min()) if len(block["lengths"]) else 0
    no = numbers(words, block["vocab"])
    if not least or not no.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), no
    places, keys = suffix_array(no, at, least)
    low, high = intervals(keys, block)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)], which, no


def longest_matches(no, at, found, which, block):
    """(document, item, document word, item word, length) of all maximal verbatim matches that hold a window."""
    k = block["first"][which + 1] - block["first"][which]
    p = np.repeat(found, k)
    pick = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(block["first"][which], k)
    item, q = block["item"][pick], block["place"][pick]
    size = np.repeat(block["lengths"][which], k)
    doc = np.searchsorted(at, p, "right") - 1
    a = block["at"][item] + q
    grows = (q > 0) & (p > at[doc])
    left = grows & (no[np.maximum(p - 1, 0)] == block["no"][np.maximum(a - 1, 0)])
    doc, item, p, q, a, size = (x[~left] for x in (doc, item, p, q, a, size))  # the match begins here
    live = np.arange(len(p))
    while len(live):
        x, y = p[live] + size[live], a[live] + size[live]
        ok = (x < at[doc[live] + 1]) & (y < block["at"][item[live] + 1])
        live, x, y = live[ok], x[ok], y[ok]
        same = no[x] == block["no"][y]
        live = live[same]
        size[live] += 1
    return doc, item, p - at[doc], q, size


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> list[str]:
    """The paths of the benchmark's blocks, written by the tasks that read it; items without a word are no windows.

    The driver gets one path per block.  A repeated task writes new files; those in the written list count."""
    folder = shared_path(benchmark.sparkSession, "benchmark")

    def run(batches):
        import pyarrow as pa
        ids, texts, size, paths = [], [], 0, []

        def write():
            block = item_block(ids, texts)
            block["ids"] = np.frombuffer(json.dumps(block["ids"]).encode(), np.uint8)
            fs, at = open_fs(f"{folder}/{uuid.uuid4().hex}.npz")
            buffer = io.BytesIO()
            np.savez(buffer, **block)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(buffer.getvalue())
            paths.append(f"{folder}/{at.rsplit('/', 1)[1]}")
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if size and size + len(t) > limit:
                    write()
                    ids, texts, size = [], [], 0
                ids.append(i or "")
                texts.append(t)
                size += len(t)
        if ids:
            write()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter(F.col(text).isNotNull())
    return sorted(r.path for r in written(items.mapInArrow(run, "path string"), "benchmark-list").collect())


def load_block(path: str) -> dict:
    """A block from its file; a worker keeps the last ones, up to CACHE_BYTES."""
    kept = worker_state("benchmark_blocks", dict)
    if path not in kept:
        fs, at = open_fs(path)
        with fs.open_input_file(at) as f:
            raw = np.load(io.BytesIO(f.read()))
            block = {k: raw[k] for k in raw.files}
        block["ids"] = json.loads(block["ids"].tobytes())
        block["bytes"] = sum(v.nbytes for v in block.values() if hasattr(v, "nbytes"))
        while kept and sum(b["bytes"] for b in kept.values()) + block["bytes"] > CACHE_BYTES:
            kept.pop(next(iter(kept)))
        kept[path] = block
    return kept[path]


def shard_matches(words, at, paths):
    """Per block, and per PAIRS of places at most: (block, document, item, document word, item word, length) of the longest
    matches of one shard."""
    for path in paths:
        block = load_block(path)
        found, which, no = search_block(words, at, block)
        pairs = np.cumsum(block["first"][which + 1] - block["first"][which])
        lo = 0
        while lo < len(found):
            hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + PAIRS, "right")))
            yield (block, *longest_matches(no, at, found[lo:hi], which[lo:hi], block))
            lo = hi


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (ids, sorted as strings), spans (start, length of
    each maximal run of hit words: the union of the longest matches).  Documents are not shuffled.

    Null or empty text: no words, no hits.  Very long texts are searched whole.  Null ids stay; repeated rows are
    separate rows.  Items without a word are ignored, items of one id are one item.  Empty tables: no rows, or no
    hits.  Other columns are not read.
    """
    paths = benchmark_blocks(benchmark)

    def run(batches):
        import pyarrow as pa
        for b in pieces(batches, 1):
            data, offsets = text_buffers(b.column(1))
            words, at = word_hashes(data, offsets, plain_rule())
            n = len(at) - 1
            edges, items = np.zeros(len(words) + 1, np.int64), [set() for _ in range(n)]
            for block, doc, item, p, _, size in shard_matches(words, at, paths):
                np.add.at(edges, at[doc] + p, 1)
                np.add.at(edges, at[doc] + p + size, -1)
                for d, i in np.unique(np.stack([doc, item], axis=1), axis=0):
                    items[d].add(block["ids"][i])
            hit = np.cumsum(edges[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            edge = np.zeros(len(words) + 1, bool)
            edge[at] = True
            starts = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | edge[:-1]))
            stops = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | edge[1:])) + 1
            cut = np.searchsorted(starts, at)
            first = starts - at[np.searchsorted(at, starts, "right") - 1]
            spans = [[{"start": int(first[k]), "length": int(stops[k] - starts[k])} for k in range(cut[i], cut[i + 1])] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,length:bigint>>")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per longest verbatim match of at least a window: doc_id, item_id, doc_word, item_word, length.

    The cases of ``contamination`` hold; repeated rows and items of one id have their own matches."""
    paths = benchmark_blocks(benchmark)

    def run(batches):
        import pyarrow as pa
        for b in pieces(batches, 1):
            data, offsets = text_buffers(b.column(1))
            words, at = word_hashes(data, offsets, plain_rule())
            for block, doc, item, p, q, size in shard_matches(words, at, paths):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array([block["ids"][i] for i in item], pa.string()),
                                                  pa.array(p), pa.array(q), pa.array(size, pa.int64())], ["doc_id", "item_id", "doc_word", "item_word", "length"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, item_id string, doc_word long, item_word long, length long")


def digests(found: DataFrame) -> DataFrame:
    """The result of ``contamination`` with its items as a count and a digest."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with a column text) without a longest match of a benchmark window; columns unchanged, nothing
    joined or shuffled.

    Rows of null or empty text stay, very long ones are searched whole, repeated rows are judged alike.  Empty benchmark:
    all rows stay; empty table: no rows.
    """
    paths, at_text = benchmark_blocks(benchmark), docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa
        for b in pieces(batches, at_text):
            data, offsets = text_buffers(b.column(at_text))
            words, at = word_hashes(data, offsets, plain_rule())
            bad = np.zeros(len(at) - 1, bool)
            for _, doc, *_ in shard_matches(words, at, paths):
                bad[doc] = True
            yield b.filter(pa.array(~bad))
    return docs.mapInArrow(keep, docs.schema)


_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), " r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
