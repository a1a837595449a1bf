"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

A tile holds the distinct fingerprints whose parts (four of 16 bits) have the same population counts.  Two
fingerprints differ in at least as many bits as the counts of their parts differ, summed up, so tile pairs whose
counts differ beyond the radius are skipped; all other tile pairs are compared bit by bit in numpy, each pair once.
Tiles of more than ``TILE`` fingerprints are cut into blocks by hash, so that no tile stays in one task.  Of the
links in a pair of blocks a spanning forest goes out, at most one row per fingerprint of the two.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lookup, pieces, ship, written
from .near_dup import components

ship(__name__)

SHINGLE = 3
SEED = 42
RADIUS = 3
#: About how many fingerprints a block holds; a task compares two blocks at a time.
TILE = 16384
#: Parts of a fingerprint that are counted: 4 let about 1 in 70 pairs of random fingerprints through, 8 about 1 in 1,700,
#: for 65 and 417 tile pairs a tile.  From FINE distinct fingerprints on it is 8; results are the same.
PARTS, FINE_PARTS, FINE = 4, 8, 1 << 25
#: Bits of a tile's code for each count.
FIELD = 5
#: Bytes of a text that are cut into words at a time, and cells of the matrix of differences.
STEP, CELLS = 1 << 20, 1 << 20

_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def word_lists(text: bytes):
    """The lower-cased words of a text, in lists of about STEP bytes."""
    lo = 0
    while lo < len(text):
        gap = _SPACE.search(text, lo + STEP) if lo + STEP < len(text) else None
        hi = gap.start() if gap else len(text)
        yield text[lo:hi].translate(_LOW).split()
        lo = hi


def bit_sums(shingles: list) -> np.ndarray:
    """How many of the shingles' hashes have each of the 64 bits set, highest bit first."""
    from xxhash import xxh64_digest
    seen = np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    per_byte = np.bincount((seen + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return (per_byte @ _BITS).ravel()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text: 0 without a word."""
    sums, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_lists(text or b""):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            sums += bit_sums([joined[a:b - 1] for a, b in zip([0, *ends], ends[shingle - 1:])])
            n += len(words) - shingle + 1
            words = words[len(words) - shingle + 1:]
        tail = words
    if not n and tail:
        sums, n = bit_sums([b" ".join(tail)]), 1
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row: map-only, written once."""
    def run(batches):
        import pyarrow as pa
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, fp long"), "fingerprints")


def steps(parts: int, radius: int) -> list[int]:
    """The differences between the codes of a tile and of the tiles in reach, each pair of tiles from one side only; 0 first."""
    def ways(k, left):
        if not k:
            return [()]
        return [(d, *rest) for d in range(-left, left + 1) for rest in ways(k - 1, left - abs(d))]
    codes = (sum(d << (FIELD * k) for k, d in enumerate(w)) for w in ways(parts, radius))
    return sorted(c for c in codes if c >= 0)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (i, j) among n nodes to keep so that the same nodes stay connected: at most n - 1 of them."""
    label, left, kept = np.arange(n), np.arange(len(i)), []
    while True:
        a, b = label[i[left]], label[j[left]]
        apart = a != b
        left, low, high = left[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(left):
            return np.concatenate(kept) if kept else left
        own, first = np.unique(high, return_index=True)
        kept.append(left[first])
        up = np.arange(n)
        up[own] = low[first]
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]


def close(x: np.ndarray, y: np.ndarray, same: bool, radius: int = RADIUS):
    """A spanning forest (positions in x, positions in y) of the pairs that differ in at most ``radius`` bits."""
    rows, cols, held = [], [], 0
    step = max(1, CELLS // max(1, len(y)))
    for lo in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(x[lo:lo + step, None] ^ y[None, :]) <= radius)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        rows.append(i)
        cols.append(j)
        held += len(i)
        if held > CELLS or lo + step >= len(x):
            i, j = np.concatenate(rows), np.concatenate(cols)
            ok = forest(i, j if same else j + len(x), len(x) + (0 if same else len(y))) if len(i) else np.zeros(0, np.int64)
            rows, cols, held = [i[ok]], [j[ok]], len(ok)
    return rows[0], cols[0]


def tiled_links(found: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``found`` (fp) within ``radius`` bits of one another."""
    width = 64 // parts
    part = lambda k: F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))
    code = sum((F.shiftleft(F.bit_count(part(k)).cast("long"), FIELD * k) for k in range(1, parts)), F.bit_count(part(0)).cast("long"))
    coded = found.select("fp", code.alias("tile"))
    sizes = coded.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("blocks"))
    # blocks are cut by hash in as many parts as their tile needs, so each holds about `tile` fingerprints at most
    cut = coded.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = written(cut.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "blocks")
    tiles = blocks.groupBy("tile").agg(F.collect_list("block").alias("ids"))  # block numbers, one for `tile` fingerprints
    near = tiles.select("tile", "ids", F.explode(F.array(*[F.lit(s).cast("long") for s in steps(parts, radius)])).alias("step"))
    near = near.withColumn("other", F.col("tile") + F.col("step"))
    pairs = near.join(tiles.select(F.col("tile").alias("other"), F.col("ids").alias("other_ids")), "other")
    pairs = pairs.select("tile", "other", F.explode("ids").alias("block"), "other_ids").select("tile", "other", "block", F.explode("other_ids").alias("other_block"))
    pairs = pairs.filter((F.col("tile") != F.col("other")) | (F.col("block") <= F.col("other_block")))
    rows = pairs.join(blocks, ["tile", "block"]).withColumn("same", (F.col("tile") == F.col("other")) & (F.col("block") == F.col("other_block")))
    rows = rows.join(blocks.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("fps").alias("other_fps")), ["other", "other_block"])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in range(b.num_rows):
                x, y = (b.column(c)[n].values.to_numpy() for c in (0, 1))
                i, j = close(x, y, b.column(2)[n].as_py(), radius)
                if len(i):
                    left.append(x[i])
                    right.append(y[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s), pa.int64()) for s in (left, right)], ["a", "b"])
    return written(rows.select("fps", "other_fps", "same").mapInArrow(run, "a long, b long"), "links")


def linked_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                        parts: int | None = None, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64 bits), component_id (smallest id reachable by links).

    Rows of equal fingerprints are linked (distance 0), so each fingerprint is compared once.  Null, empty or wordless
    text: fingerprint 0, linked like any other.  Very long texts are hashed in steps, whole.  Repeated rows stay
    separate rows; a null id is larger than all others, and a component of null ids only has a null id.  Empty table:
    no rows.  Other columns are not read.
    """
    rows = fingerprints(docs, doc_id, text, shingle)
    found = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "distinct")
    if parts is None:
        parts = PARTS if found.count() < FINE else FINE_PARTS
    links = tiled_links(found, radius, parts, tile)
    # hashed names, a bijection of 64 bits: links of fingerprints in ascending chains can't slow the components down
    names = components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    labelled = found.withColumn("node", F.xxhash64("fp")).join(names, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = written(labelled.select("fp", "n", "least", "label"), "labelled")
    per = written(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    classes = written(lookup(labelled.select("fp", F.col("n").alias("_rows"), "label"), per, "label").select("fp", F.col("_rows").alias("n"), "component_id"), "classes")
    return lookup(rows, classes, "fp")


def simhash_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """``linked_fingerprints`` with the fingerprint in 16 lowercase hex digits: doc_id, fingerprint, component_id.  The same cases hold."""
    rows = linked_fingerprints(docs, **kw)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
