"""What the operators of this subpackage share: tables in the shared folder, ranks, word arrays, files."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The ASCII white space of the word rule [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step holds at a time.
CHUNK = 2 << 20


def ship(module_name: str) -> None:
    """Send this module's functions to the tasks by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank among the rows of equal ``by`` in ``order``, without a task per key.

    Rows are dealt to range partitions of (by, order) and written with their partition's number; ranks are
    the row number in (partition, by) plus the rows of the same ``by`` in earlier partitions.  That offset
    table has one row per partition and key met in it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in by], *order).withColumn("_pid", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    from pyspark.sql import Window as W
    counts = dealt.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_pid", *by).orderBy(*order)))
    on = (F.col("_pid") == F.col("_p"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (local.join(offsets, on).withColumn(name, (F.col("_rn") + F.col("_before")).cast("long"))
            .drop("_rn", "_before", "_p", "_pid", *[f"_by_{c}" for c in by]))


#: A key is hot if it has more than one in HOT of all rows: fewer than HOT keys are.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``; its ``n``: how many of ``rows`` have that key, dropped here).

    Both are written tables.  The hot keys, fewer than HOT, are broadcast and their rows stay where they are; only rows of
    other keys are dealt out by key, so no key brings more than one in HOT of them to a task.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > F.lit(total)
    own = [c for c in table.columns if c not in (key, "n")]
    named = table.select(F.col(key).alias("_key"), "n", F.struct(*own).alias("_hot"))
    marked = rows.join(F.broadcast(named.filter(hot).drop("n")), F.col(key) == F.col("_key"), "left").drop("_key")
    rest = named.filter(~hot).select("_key", F.col("_hot").alias("_rest"))
    plain = marked.filter(F.col("_hot").isNull()).drop("_hot").join(rest, F.col(key) == F.col("_key"), how)
    return (marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, "_hot.*")
            .unionByName(plain.select(*rows.columns, "_rest.*")))


def arrow_kind(kind: str):
    """Arrow type of an id column of Spark's simple type ``kind``: whole numbers and text."""
    import pyarrow as pa
    kinds = {"string": pa.string(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    if kind not in kinds:
        raise ValueError(f"ids of type {kind}: whole numbers or text are wanted")
    return kinds[kind]


def size_of(text="text"):
    """Number of [^\\x20\\x09-\\x0D]+ words of a text column (null: 0), native."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def remainder(doc_id: str, m: int):
    """crc32 of the id as text, modulo ``m`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(m)


# --- word arrays over Arrow text buffers ------------------------------------------------------------------

_RNG = np.random.default_rng(20240801)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int):
    """p^0..p^n and its inverses modulo 2^64."""
    out = []
    for p in (_P, _PINV):
        a = np.full(n + 1, p, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out


def mix(h):
    """Finaliser of 64-bit hashes (a published splitmix64 step)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column):
    """(bytes, offsets) of an Arrow string or binary array; a null is an empty text."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def space_rule():
    """(is a word byte, lower-cased byte) of the rule [^\\x20\\x09-\\x0D]+."""
    word, low = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    word[[0x20, 9, 10, 11, 12, 13]] = False
    low[65:91] += 32
    return word, low


def plain_rule():
    """The same of the rule [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ on lower-cased text: digits, a-z, non-ASCII."""
    _, low = space_rule()
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return word, low


def word_hashes(data, offsets, rule):
    """64-bit hashes of all words of the texts in order, and the index of each text's first word (one more at the end).

    Works through the bytes in chunks that end between texts, or in a long text after a non-word byte.
    """
    word, low = rule
    value = _BYTE[low]
    n, hashes, counts, lo = len(data), [], np.zeros(len(offsets), np.int64), 0
    p, q = _powers(min(n, CHUNK))
    while lo < n:
        hi = min(n, lo + CHUNK)
        if hi < n:
            cut = offsets[np.searchsorted(offsets, hi, "right") - 1]
            if cut <= lo:  # inside one long text: go on to its next non-word byte or its end
                end = offsets[np.searchsorted(offsets, hi, "left")]
                while hi < end and word[data[hi]]:
                    gap = np.flatnonzero(~word[data[hi:min(end, hi + CHUNK)]])
                    hi = int(hi + gap[0]) if len(gap) else int(min(end, hi + CHUNK))
            else:
                hi = int(cut)
        b = data[lo:hi]
        w = word[b]
        first = np.zeros(hi - lo + 1, bool)
        inner = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, "right")] - lo
        first[inner] = True
        first[0] = first[-1] = True
        before = np.concatenate(([False], w[:-1]))
        after = np.concatenate((w[1:], [False]))
        s = np.flatnonzero(w & (~before | first[:-1]))
        e = np.flatnonzero(w & (~after | first[1:])) + 1
        if hi - lo >= len(p):
            p, q = _powers(hi - lo)
        c = np.empty(hi - lo + 1, np.uint64)
        c[0] = 0
        np.cumsum(value[b] * p[:hi - lo], out=c[1:])
        hashes.append(mix((c[e] - c[s]) * q[s] + (e - s).astype(np.uint64)))
        d = np.searchsorted(offsets, s + lo, "right")
        if len(d):
            counts += np.bincount(d, minlength=len(counts))[:len(counts)]
        lo = hi
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def pieces(batches, column: int, limit: int = 4 << 20):
    """The batches in slices of about ``limit`` bytes of a text column, so that arrays over words stay small."""
    import pyarrow.compute as pc
    for b in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        cut = [0, *(np.flatnonzero(n[1:] // limit != n[:-1] // limit) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


# --- files in the shared folder ---------------------------------------------------------------------------

def open_fs(uri: str):
    """(file system, path) of a Hadoop-style URI, by pyarrow: file:, hdfs:, s3: ... work alike in every task."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def worker_state(key: str, make):
    """A value that stays in a reused Python worker from task to task (a cache: never needed for a right result)."""
    import types
    home = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if not hasattr(home, key):
        setattr(home, key, make())
    return getattr(home, key)
