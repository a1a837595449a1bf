"""Suffix-array dedup: repeated byte strings found by merging Burrows-Wheeler transforms of shards.

1. Every document byte string of SPAN bytes is assigned to its anchor, the least hash of the K-grams in it; equal
   strings have equal anchors.  Anchors met once in the corpus are counted out: no string around them repeats.
2. What lies around repeated anchors is cut into segments and dealt to buckets by anchor.  A bucket's segments
   form shards; each shard sorts its own suffixes and yields its transform (the symbols before them).
3. The transforms of a bucket are merged by refining the interleave of their rows: each pass reads the merged
   symbols and deals the rows out by them, stably, which orders them by one more step of their suffixes.  Rows
   that part in a pass get a block border, which is their common prefix; after SPAN bytes the blocks are the
   repeated intervals.  No suffix of one shard is sorted against those of another.
4. In each interval all strings but the first of the corpus are removed.

Documents are kept as shard files in the shared folder, so texts are never shuffled; only anchors, segments
around repeated ones, and removed ranges are.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, open_fs, shared_path, ship, text_buffers, written

ship(__name__)

SPAN = 100
#: Bytes of an anchor's K-gram, and K-grams in a string of SPAN bytes.
K = 32
WIDE = SPAN - K + 1
#: Bytes that one pass of the transforms reads; SPAN is a multiple of it.
STEP = 4
#: Text of a shard file, and of a shard whose suffixes are sorted at once.
FILE_BYTES, SHARD_BYTES = 8 << 20, 256 << 10
CHUNK = 1 << 16
#: Anchors of more occurrences have their strings dealt out one by one, by their own hash, about so many together.
HOT = 4096
#: Segment bytes of a bucket that are unpacked at once, and those whose transforms are merged at once: whole anchors, so
#: that memory doesn't grow with the bucket.
PART_BYTES, MERGE_BYTES = 16 << 20, 1 << 20
#: Buckets per shuffle partition.
SPREAD = 4
_LOW = np.uint64((1 << 24) - 1)
_SIGN = mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(b):
    """64-bit hashes of all K-grams of a byte array, by doubling."""
    h = _SIGN[b]
    p, s = 0x9E3779B97F4A7C15, 1
    while s < K:
        nxt = h[:-s] * np.uint64(p)
        nxt += h[s:]
        h, p, s = nxt, p * p % (1 << 64), s * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data, offsets):
    """Runs of strings with one anchor: (first byte of the first string, number of strings, 60-bit anchor).

    A string's anchor is the leftmost least K-gram hash in it, so it depends on the string alone.
    """
    firsts, counts, keys = [], [], []
    for lo in range(0, max(0, len(data) - SPAN + 1), CHUNK):
        hi = min(lo + CHUNK, len(data) - SPAN + 1)
        h = gram_hashes(data[lo:hi + SPAN - 1])
        m = h & ~_LOW
        m |= np.arange(len(h), dtype=np.uint64)
        s = 1
        while 2 * s <= WIDE:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        m = np.minimum(m[:hi - lo], m[WIDE - s:WIDE - s + hi - lo])
        whole = np.ones(hi - lo + 1, bool)
        whole[-1] = False
        for e in offsets[np.searchsorted(offsets, lo, "right"):np.searchsorted(offsets, hi + SPAN, "left")]:
            whole[max(0, e - lo - SPAN + 1):max(0, min(e - lo, hi - lo))] = False  # strings that would cross the end of a document
        first = whole[:-1].copy()
        first[1:] &= ~whole[:-2] | (m[1:] != m[:-1])
        at = np.flatnonzero(first)
        if not len(at):
            continue
        stop = np.flatnonzero(~whole)
        nxt = np.append(at[1:], hi - lo)
        ends = np.minimum(nxt, stop[np.searchsorted(stop, at)])
        firsts.append(at + lo)
        counts.append(ends - at)
        keys.append(h[(m[at] & _LOW).astype(np.int64)] >> np.uint64(4))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(keys)


# --- shard files ------------------------------------------------------------------------------------------

def save_shard(path: str, ids, data, offsets):
    import zstandard
    fs, where = open_fs(path)
    with fs.open_output_stream(where, compression=None) as f:
        raw = np.asarray(offsets, np.int64).tobytes() + np.asarray(ids, np.int64).tobytes() + data.tobytes()
        f.write(struct.pack("<q", len(ids)) + zstandard.ZstdCompressor(level=1).compress(raw))


def load_shard(path: str):
    """(ids, data, offsets) of a shard file; ids are those of its documents in order."""
    import zstandard
    fs, where = open_fs(path)
    with fs.open_input_file(where) as f:
        raw = f.read()
    n = struct.unpack_from("<q", raw)[0]
    raw = zstandard.ZstdDecompressor().decompress(raw[8:])
    return np.frombuffer(raw, np.int64, n, 8 * (n + 1)), np.frombuffer(raw, np.uint8, -1, 8 * (2 * n + 1)), np.frombuffer(raw, np.int64, n + 1)


NULL_ID = np.iinfo(np.int64).max


def shard_rows(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Writes the documents to shard files, in id order in each, and returns (bucket, shard, anchors) rows.

    Each anchor carries the logarithm of its count in the shard in its low four bits.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, seq, held, size = TaskContext.get(), 0, [], 0
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)

        def flush(held):
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(0).cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy()
            order = np.argsort(ids, kind="stable")
            data, offsets = text_buffers(table.column(1).take(pa.array(order)))
            path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}"
            save_shard(path, ids[order], data, offsets)
            key, n = np.unique(anchors(data, offsets)[2], return_counts=True)
            level = np.minimum(15, np.ceil(np.log2(n)).astype(np.uint64))
            to = (key % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            packed, cut = (key << np.uint64(4) | level)[by], np.searchsorted(to[by], np.arange(buckets + 1))
            some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            # the row of bucket -1 names the shard even where it has no anchor
            return pa.RecordBatch.from_arrays([pa.array([-1] + some, pa.int32()), pa.array([path] * (len(some) + 1)),
                                               pa.array([b""] + [packed[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary())], ["bucket", "shard", "anchors"])
        for b in batches:
            at = 0
            lengths = np.diff(text_buffers(b.column(1))[1])
            for i in range(b.num_rows):
                size += int(lengths[i])
                if size >= FILE_BYTES:
                    held.append(b.slice(at, i + 1 - at))
                    yield flush(held)
                    held, size, at, seq = [], 0, i + 1, seq + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield flush(held)
    rows = docs.mapInArrow(run, "bucket int, shard string, anchors binary")
    return written(rows, "anchors")


def repeated_anchors(table):
    """Of one bucket's anchors, those met twice or more, for each shard: (shard, anchors with the logarithm of their parts)."""
    import pyarrow as pa
    blobs = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
    all_ = np.concatenate(blobs)
    key, back = np.unique(all_ >> np.uint64(4), return_inverse=True)
    times = np.bincount(back.reshape(-1), weights=np.exp2((all_ & np.uint64(15)).astype(float)))
    parts = np.where(times > HOT, np.minimum(15, np.ceil(np.log2(np.maximum(1, times / HOT * WIDE)))), 0).astype(np.uint64)
    many, tag = times > 1, key << np.uint64(4) | parts
    out, at = [], 0
    for shard, x in zip(table.column("shard").to_pylist(), blobs):
        own = back.reshape(-1)[at:at + len(x)]
        at += len(x)
        out.append((shard, tag[own[many[own]]].tobytes()))
    return pa.table({"shard": pa.array([s for s, _ in out]), "repeated": pa.array([x for _, x in out], pa.binary())})


def row_by_row(batch):
    """The rows of a batch of two columns; only one row's lists are Python objects at a time."""
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def segment_rows(repeated: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, blob) of the segments around repeated anchors: each distinct segment of a shard once.

    Later copies in the shard are all removed: they go as ranges, in a row of their own.
    """
    def run(batches):
        import pyarrow as pa
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for shard, blobs in row_by_row(b):
                tags = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs] or [np.zeros(0, np.uint64)]))
                if not len(tags):
                    continue
                ids, data, offsets = load_shard(shard)
                first, count, key = anchors(data, offsets)
                spot = np.minimum(np.searchsorted(tags >> np.uint64(4), key), len(tags) - 1)
                hit = (tags[spot] >> np.uint64(4)) == key
                first, count, key, parts = first[hit], count[hit], key[hit], (tags[spot[hit]] & np.uint64(15)).astype(np.int64)
                doc = np.searchsorted(offsets, first, "right") - 1
                raw, seen, cut, gone = data.tobytes(), {}, [], []
                for f, n, k, p, d in zip(first.tolist(), count.tolist(), key.tolist(), parts.tolist(), doc.tolist()):
                    for f, n in [(f, n)] if not p else [(f + j, 1) for j in range(n)]:
                        s = raw[f:f + n + SPAN - 1]
                        if (s, k) in seen:
                            at = f - int(offsets[d])
                            if gone and gone[-1][0] == d and at <= gone[-1][2]:  # goes on where the last range ends
                                gone[-1] = (d, gone[-1][1], at + n + SPAN - 1)
                            else:
                                gone.append((d, at, at + n + SPAN - 1))
                        else:
                            seen[(s, k)] = None
                            sub = int.from_bytes(hashlib.blake2b(s, digest_size=4).digest(), "little") % (1 << p) if p else 0
                            cut.append(((k * 0x9E3779B1 + sub * 0x85EBCA77 >> 7) % buckets, k, d, int(ids[d]), f - int(offsets[d]), n, s))
                cut.sort(key=lambda x: x[0])
                rows = []
                i = 0
                while i < len(cut):
                    j = i
                    while j < len(cut) and cut[j][0] == cut[i][0]:
                        j += 1
                    part = cut[i:j]
                    cols = [np.array([x[c] for x in part], kind).tobytes() for c, kind in ((1, np.uint64), (2, np.int32), (3, np.int64), (4, np.int64), (5, np.int32))]
                    rows.append((part[0][0], pack.compress(struct.pack("<q", len(part)) + b"".join(cols) + b"".join(x[6] for x in part))))
                    i = j
                if gone:
                    rows.append((-1, np.array(gone, np.int64).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([shard] * len(rows)),
                                                  pa.array([x for _, x in rows], pa.binary())], ["bucket", "shard", "blob"])
    return repeated.mapInArrow(run, "bucket int, shard string, blob binary")


# --- transforms and their merge ---------------------------------------------------------------------------

class Rows:
    """All suffixes of a bucket's segments, the empty one of each too: ``code`` of the STEP bytes at each place (0
    where fewer are left), ``before`` the code of the STEP bytes before it (0 where there are fewer)."""

    def __init__(self, segments: list):
        self.lengths = np.array([len(s) + 1 for s in segments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        text = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.uint32)
        n = len(text)
        word = np.zeros(n, np.uint32)
        if n >= STEP:
            word[:n - STEP + 1] = text[:-3] << 24 | text[1:-2] << 16 | text[2:-1] << 8 | text[3:]
        left = np.repeat(self.starts[1:], self.lengths) - 1 - np.arange(n)
        done = np.arange(n) - np.repeat(self.starts[:-1], self.lengths)
        names, code = np.unique(word, return_inverse=True)
        kind = np.uint16 if len(names) < 65535 else np.uint32
        self.code = np.where(left >= STEP, code.reshape(-1) + 1, 0).astype(kind)
        self.before = np.zeros(n, kind)
        self.before[STEP:] = np.where(done[STEP:] >= STEP, self.code[:-STEP], 0)


def shard_order(code) -> np.ndarray:
    """The suffixes of one shard (a stretch of whole segments) in order to a depth of at least SPAN bytes.

    Prefix doubling over steps: places with no whole step left are lowest and all different.
    """
    n = len(code)
    rank = code.astype(np.int64)
    ends = np.flatnonzero(code == 0)
    rank[code > 0] += len(ends)
    rank[ends] = np.arange(len(ends))
    reach = STEP
    while True:
        order = np.argsort(rank)
        if reach >= SPAN:
            return order
        r = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
        rank = dense * (n + 1)
        rank[:max(0, n - reach)] += dense[reach:]
        reach *= 2


def merge_transforms(orders: list, before, inner, counts):
    """Interleaves the wanted rows of several shards' transforms by their suffixes' first SPAN bytes.

    ``orders[s]`` has shard s's rows (places in the text) in its own order, ``before`` the symbol before each place,
    ``inner`` the place in its segment and ``counts`` the wanted strings of that segment.  Only rows that the
    remaining passes lead to a wanted string take part: before pass i those whose place is SPAN - i * STEP to
    SPAN - i * STEP + counts - 1.  A pass reads the symbols of the rows in their interleave (the k-th row of a
    shard there is the k-th in the shard's order), and deals the rows out by symbol, stably: they then stand for
    the places STEP earlier, in order of one more step.  Returns (interleave, border): the shard of each row, and
    whether its first SPAN bytes differ from those of the row above.
    """
    passes = SPAN // STEP
    kind = np.uint8 if len(orders) < 256 else np.uint16
    ahead = [inner[o] - SPAN for o in orders]
    room = [counts[o] for o in orders]
    z = border = block = None
    for i in range(passes):
        rows = [o[(a >= -i * STEP) & (a < c - i * STEP)] for o, a, c in zip(orders, ahead, room)]
        if z is None:  # nothing read yet: all suffixes are alike
            z = np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(kind)
            block = np.zeros(len(z), np.int32)
        merged = np.empty(len(z), before.dtype)
        merged[np.argsort(z, kind="stable")] = before[np.concatenate(rows)]
        to = np.argsort(merged, kind="stable")
        z, s, above = z[to], merged[to], block[to]
        border = np.ones(len(z), bool)
        np.not_equal(s[1:], s[:-1], out=border[1:])
        border[1:] |= above[1:] != above[:-1]
        block = np.cumsum(border, dtype=np.int32)
    return z, border


def repeated_strings(segments: list, counts, place) -> np.ndarray:
    """For each wanted string of the segments (segment i has ``counts[i]``, at its first bytes) whether an equal one
    comes earlier in the corpus; ``place[i]`` is the corpus place of segment i's first string."""
    rows = Rows(segments)
    cuts, size = [0], 0
    for i, n in enumerate(rows.lengths.tolist()):
        size += n
        if size >= max(SHARD_BYTES, len(rows.code) // 200):
            cuts.append(i + 1)
            size = 0
    if cuts[-1] != len(segments):
        cuts.append(len(segments))
    orders = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = int(rows.starts[a]), int(rows.starts[b])
        orders.append(shard_order(rows.code[lo:hi]) + lo)
    inner = (np.arange(len(rows.code)) - np.repeat(rows.starts[:-1], rows.lengths)).astype(np.int32)
    wanted = np.repeat(np.asarray(counts, np.int32), rows.lengths)
    z, border = merge_transforms(orders, rows.before, inner, wanted)
    where = np.empty(len(z), np.int64)
    where[np.argsort(z, kind="stable")] = np.concatenate([o[inner[o] < wanted[o]] for o in orders])  # the place in the text of each merged row
    seg, inner = np.searchsorted(rows.starts, where, "right") - 1, inner[where]
    at = np.asarray(place)[seg] + inner
    first = np.flatnonzero(border)
    least = np.minimum.reduceat(at, first) if len(at) else at
    again = at > np.repeat(least, np.diff(np.append(first, len(at))))
    out = np.zeros(int(np.sum(counts)), bool)
    out[np.concatenate([[0], np.cumsum(counts)])[seg] + inner] = again
    return out


def merged_ranges(kept: list, gone: dict):
    """Appends the ranges of all strings but the first of the corpus of some anchors' segments (text, place) to ``gone``."""
    kept.sort(key=lambda x: x[1])
    rank = {d: r for r, d in enumerate(sorted({w[:3] for _, w in kept}))}
    counts = np.array([w[4] for _, w in kept], np.int64)
    again = repeated_strings([s for s, _ in kept], counts, np.array([(rank[w[:3]] << 40) + w[3] for _, w in kept], np.int64))
    edge = np.diff(np.concatenate([[False], again, [False]]).astype(np.int8))
    seg_at = np.concatenate([[0], np.cumsum(counts)])
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for a, b in zip(lo.tolist(), hi.tolist()):
        while a < b:  # a stretch may go on into the next segment
            x = int(np.searchsorted(seg_at, a, "right")) - 1
            e = min(b, int(seg_at[x + 1]))
            _, (i, no, d, f, c, shard) = kept[x]
            gone.setdefault(shard, []).append((d, f + a - int(seg_at[x]), f + e - int(seg_at[x]) - 1 + SPAN))
            a = e


def part_ranges(rows: list, part: int, parts: int) -> dict:
    """shard -> removed ranges of the anchors of one part of a bucket's (shard, blob) rows."""
    import zstandard
    unzip, gone, found = zstandard.ZstdDecompressor(), {}, {}
    for no, (shard, blob) in enumerate(rows):
        raw = unzip.decompress(blob)
        n, at = struct.unpack_from("<q", raw)[0], 8
        cols = []
        for kind in (np.uint64, np.int32, np.int64, np.int64, np.int32):
            cols.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        cols.append(at + np.cumsum(cols[4] + (SPAN - 1), dtype=np.int64))
        mine = np.flatnonzero(mix(cols[0]) % np.uint64(parts) == part)
        for k, d, i, f, c, end in zip(*(x[mine].tolist() for x in cols)):
            found.setdefault((k, raw[end - c - SPAN + 1:end]), []).append((i, no, d, f, c, shard))
    by_anchor = {}
    for (k, s), where in found.items():
        where.sort()
        for i, no, d, f, c, shard in where[1:]:
            gone.setdefault(shard, []).append((d, f, f + c + SPAN - 1))
        by_anchor.setdefault(k, []).append((s, where[0]))
    del found
    kept, size = [], 0
    for group in by_anchor.values():
        # an anchor with one distinct segment has no two equal strings: its place in a string is part of the string;
        # neither has one whose segments, all distinct, are single strings, as those of a hot anchor are
        if len(group) > 1 and any(w[4] > 1 for _, w in group):
            kept += group
            size += sum(len(s) for s, _ in group)
            if size >= MERGE_BYTES:
                merged_ranges(kept, gone)
                kept, size = [], 0
    if kept:
        merged_ranges(kept, gone)
    return gone


def bucket_ranges(table):
    """(shard, removed ranges) of one bucket; rows of bucket -1 are ranges already.

    A large bucket is worked through in parts of its anchors: equal strings have equal ones."""
    import pyarrow as pa
    import zstandard
    shards, blobs = table.column("shard").to_pylist(), table.column("blob").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        return pa.table({"shard": pa.array(shards), "ranges": pa.array(blobs, pa.binary())})
    rows, out = sorted(zip(shards, blobs)), {}
    parts = 1 + sum(zstandard.frame_content_size(x) for x in blobs) // PART_BYTES
    for part in range(parts):
        for shard, ranges in part_ranges(rows, part, parts).items():
            out.setdefault(shard, []).append(np.array(ranges, np.int64).tobytes())
    return pa.table({"shard": pa.array(list(out), pa.string()), "ranges": pa.array([b"".join(x) for x in out.values()], pa.binary())})


def cleaned_rows(ranges: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: what is left of it after all its ranges are removed."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for shard, blobs in row_by_row(b):
                ids, data, offsets = load_shard(shard)
                gone = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in blobs] or [np.zeros((0, 3), np.int64)])
                gone = gone[np.lexsort((gone[:, 1], gone[:, 0]))]
                doc, first, last = gone[:, 0], offsets[gone[:, 0]] + gone[:, 1], offsets[gone[:, 0]] + gone[:, 2]
                reach = np.maximum.accumulate(last) if len(last) else last  # texts follow each other, so this never runs into the next
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])
                at = np.flatnonzero(new)
                doc, first, last = doc[at], first[at], reach[np.append(at[1:], len(new)) - 1] if len(at) else last[:0]
                n = len(ids)
                removed = np.zeros(n, np.int64)
                np.add.at(removed, doc, last - first)
                cut, raw, texts = np.searchsorted(doc, np.arange(n + 1)), memoryview(data), []
                for i in range(n):
                    edges = [offsets[i], *np.stack([first[cut[i]:cut[i + 1]], last[cut[i]:cut[i + 1]]], 1).ravel().tolist(), offsets[i + 1]]
                    texts.append(b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2])]))
                cols = [pa.array(ids, mask=ids == NULL_ID), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(cut)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts])] + [pa.array(texts, pa.binary())] * with_text
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
    return ranges.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes).

    Ids are integers.  Null or empty text: no bytes, one row.  Null ids stand after all others; rows that repeat an
    id stand in the order of their shard files.  Empty table: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = shard_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shared_path(spark, "shards"), buckets)
    names = rows.filter("bucket = -1").select("shard")
    again = rows.filter("bucket >= 0").groupBy("bucket").applyInArrow(repeated_anchors, "shard string, repeated binary")
    n = buckets // SPREAD
    again = again.repartition(n, "shard").groupBy("shard").agg(F.collect_list("repeated").alias("repeated"))
    gone = segment_rows(again, buckets).withColumn("_own", F.when(F.col("bucket") < 0, F.col("shard"))).groupBy("bucket", "_own")
    gone = gone.applyInArrow(bucket_ranges, "shard string, ranges binary")
    gone = written(gone, "ranges")
    every = gone.unionByName(names.withColumn("ranges", F.lit(b"")))
    return cleaned_rows(every.repartition(n, "shard").groupBy("shard").agg(F.collect_list("ranges").alias("ranges")), with_text)
