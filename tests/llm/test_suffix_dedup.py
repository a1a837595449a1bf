import hashlib
import random

import numpy as np
import pytest

from sellerscope.llm import suffix_dedup as sd

from .conftest import odd_rows, words


def brute(rows):
    """Every byte in a 100-byte string seen earlier; rows of one text and id count in order."""
    out, seen = [], set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(b[p:p + 100])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in sd.remove_repeats(df).collect()), key=str)


def planted():
    r = random.Random(5)
    p = "".join(r.choice("abcdefg ") for _ in range(150))
    return [(90, "a" * 500), (91, "ab" * 300 + "a" * 120), (94, p + "x" * 99 + p), (95, "é" * 130 + p[20:140]), (96, p[:99]), (97, p[:100]),
            (98, "xyz" * 70 + p[3:110] + "xyz" * 60), (99, "q" * 99), (100, "q" * 99 + "r"), (101, "q" * 100)]


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i + 10_000, t) for i, t in planted()]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_are_split_without_loss(spark, monkeypatch, hot):
    common = words(40, 9)
    rows = [(i, words(30, 100 + i) + " " + common + " " + words(25, 900 + i)) for i in range(60)] + planted()
    monkeypatch.setattr(sd, "HOT", hot)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(odd):
    assert run(odd) == brute([(r[0], r[1]) for r in odd_rows()])


def test_empty_table(empty):
    assert run(empty) == []


def test_small_shards_and_files_give_the_same(spark, docs, monkeypatch):
    rows = docs.limit(60).collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    want = run(df)
    monkeypatch.setattr(sd, "FILE_BYTES", 20_000)
    monkeypatch.setattr(sd, "SHARD_BYTES", 500)
    assert run(df) == want


def test_merge_orders_rows_by_their_first_bytes():
    r = random.Random(1)
    segments = [bytes(r.choice(b"ab") for _ in range(r.randint(100, 180))) for _ in range(12)]
    segments += [segments[0][:120], segments[3] + b"b"]
    counts = [len(s) - 99 for s in segments]
    place = np.arange(len(segments)) << 40
    got = sd.repeated_strings(segments, counts, place)
    seen, want = set(), []
    for s in segments:
        for p in range(len(s) - 99):
            want.append(s[p:p + 100] in seen)
            seen.add(s[p:p + 100])
    assert got.tolist() == want


def test_removed_text_is_returned_on_demand(spark):
    t = words(60, 4)
    got = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(spark.createDataFrame([(1, t), (2, "before " + t + " after")], "doc_id long, text string"), with_text=True).collect()}
    assert got == {1: t.encode(), 2: b"before  after"}


def bucket(rows):
    """A bucket's rows as segment_rows makes them, of (shard, [(anchor, document, id, place, count, text)])."""
    import struct

    import pyarrow as pa
    import zstandard
    out = []
    for shard, part in rows:
        cols = [np.array([x[c] for x in part], kind).tobytes() for c, kind in ((0, np.uint64), (1, np.int32), (2, np.int64), (3, np.int64), (4, np.int32))]
        out.append((7, shard, zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(part)) + b"".join(cols) + b"".join(x[5] for x in part))))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "shard": [x[1] for x in out], "blob": pa.array([x[2] for x in out], pa.binary())})


def removed(table):
    return {(s, *r) for s, x in zip(table.column("shard").to_pylist(), table.column("ranges").to_pylist()) for a in [np.frombuffer(x, np.int64).reshape(-1, 3)]
            for d, lo, hi in a.tolist() for r in [(d, p) for p in range(lo, hi)]}


def test_large_buckets_are_merged_in_parts_of_whole_anchors(monkeypatch):
    r, rows = random.Random(3), []
    family = [bytes(r.choice(b"abcd") for _ in range(300)) for _ in range(40)]
    for no in range(3):
        part = []
        for i in range(120):
            k, at = r.randrange(40), r.randrange(130)
            n = r.randint(1, 69)
            part.append((k, i, no * 1000 + i, r.randrange(5), n, family[k][at:at + n + 99]))
        rows.append((f"s{no}", part))
    whole, sizes = removed(sd.bucket_ranges(bucket(rows))), []
    plain = sd.repeated_strings
    monkeypatch.setattr(sd, "repeated_strings", lambda segments, *a: sizes.append(sum(map(len, segments))) or plain(segments, *a))
    monkeypatch.setattr(sd, "PART_BYTES", 10_000)
    monkeypatch.setattr(sd, "MERGE_BYTES", 2_000)
    assert removed(sd.bucket_ranges(bucket(rows))) == whole and whole
    assert len(sizes) > 5 and max(sizes) < 2_000 + 12 * 168  # one merge of the whole bucket before


def test_single_strings_of_a_hot_anchor_are_not_merged(monkeypatch):
    texts = [bytes([97 + i % 26, 97 + i // 26]) * 50 for i in range(60)]
    rows = [("s0", [(5, i, i, 0, 1, t) for i, t in enumerate(texts)]), ("s1", [(5, i, 100 + i, 3, 1, t) for i, t in enumerate(texts[:7])])]
    monkeypatch.setattr(sd, "repeated_strings", lambda *a: pytest.fail("distinct strings were merged"))
    assert removed(sd.bucket_ranges(bucket(rows))) == {("s1", i, p) for i in range(7) for p in range(3, 103)}
