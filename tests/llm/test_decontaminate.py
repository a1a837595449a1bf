import hashlib
import re

import pytest

from sellerscope.llm import decontaminate as dc

from .conftest import odd_rows, words

RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return RULE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j:j + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[tuple(w[p:p + n])]
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, words(30, 50)), (2, words(12, 51) + " " + words(30, 50)), (3, "Short Item, three"), (4, None), (5, ""), (6, "!!!"), (7, "tie " * 15), (7, "lone"), (8, words(10, 52))]


def corpus():
    a, c = words(30, 50), words(10, 52)
    return [(100, "lead " + a.upper() + " trail"), (101, words(5) + " " + " ".join(a.split()[4:20])), (102, " ".join(a.split()[:9])), (103, "a short-item three b"),
            (104, "tie " * 40), (105, c + " " + c), (106, "alone lone"), (107, " ".join(c.split()[:9] + ["x"]))] + [(r[0], r[1]) for r in odd_rows()]


def run(spark, rows, items):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return dc.digests(dc.contamination(d, spark.createDataFrame(items, "item_id long, text string")))


def test_against_brute_force(spark):
    assert sorted((tuple(r) for r in run(spark, corpus(), ITEMS).collect()), key=str) == brute(corpus(), ITEMS)


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    monkeypatch.setattr(dc.benchmark_blocks, "__defaults__", ("item_id", "text", 60))
    assert sorted((tuple(r) for r in run(spark, corpus(), ITEMS).collect()), key=str) == brute(corpus(), ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS).count() == 0
    assert [tuple(r)[1:4] for r in run(spark, [(1, "some words")], []).collect()] == [(2, 0, 0)]


def test_longest_matches(spark):
    a = words(30, 50).split()
    rows = [(1, "x y " + " ".join(a[3:21]) + " z"), (2, " ".join(a[:12]) + " q " + " ".join(a[12:25]))]
    got = sorted(tuple(r) for r in dc.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(a))], "item_id long, text string")).collect())
    assert got == [(1, "5", 2, 3, 18), (2, "5", 0, 0, 12), (2, "5", 13, 12, 13)]


def test_spans_and_drop(spark, odd):
    bench = spark.createDataFrame([(1, words(30, 1))], "item_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in dc.contamination(odd, bench).collect() if r.doc_id}
    assert spans[1] == [(0, 30)] and spans[3] == []
    kept = dc.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 5, 6, 7, 8, 8, 9, 10, 11]


def test_hits_are_the_union_of_the_longest_matches(spark):
    d, b = spark.createDataFrame(corpus(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    covered = {}
    for r in dc.matches(d.filter("doc_id is not null"), b).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.doc_word, r.doc_word + r.length))
    for r in dc.contamination(d.filter("doc_id is not null"), b).collect():
        own = {w for s in r.spans for w in range(s.start, s.start + s.length)}
        assert own == covered.get(r.doc_id, set()) and len(own) == r.n_hit


def test_a_worker_keeps_few_blocks(spark, monkeypatch):
    import inspect
    assert "toLocalIterator" not in inspect.getsource(dc)
    monkeypatch.setattr(dc.benchmark_blocks, "__defaults__", ("item_id", "text", 60))
    paths = dc.benchmark_blocks(spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1))
    assert len(paths) > 3
    monkeypatch.setattr(dc, "CACHE_BYTES", 1)
    kept = dc.worker_state("benchmark_blocks", dict)
    for p in paths * 2:
        assert len(dc.load_block(p)["wins"]) >= 0 and list(kept) == [p]


def test_many_places_are_extended_in_steps(spark, monkeypatch):
    monkeypatch.setattr(dc, "PAIRS", 3)
    assert sorted((tuple(r) for r in run(spark, corpus(), ITEMS).collect()), key=str) == brute(corpus(), ITEMS)
