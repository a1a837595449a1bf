import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sellerscope.llm import near_dup as nd

from .conftest import odd_rows, words


def shingles(t, length=3):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()


def brute(rows, percent=85, length=3):
    """Components over all pairs; rows in their order, the component's smallest id (null last)."""
    sets = [shingles(t, length) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if not sets[i] else least[root(i)]
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def family(seed, n, size, edits):
    """A text and copies of it with a few words changed."""
    r = random.Random(seed)
    base = words(size, seed).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"new{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def run(df):
    return sorted((tuple(r) for r in nd.near_duplicates(df).collect()), key=str)


def test_against_all_pairs(spark):
    texts = [t for s, (n, size, edits) in enumerate([(12, 200, 14), (8, 60, 4), (6, 400, 30), (10, 25, 2), (5, 12, 1)]) for t in family(s, n, size, edits)]
    texts += [words(50, 700 + i) for i in range(20)] + texts[:5]
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_chains_are_one_component(spark):
    base = words(300, 8).split()
    rows = [(i, " ".join(base[4 * i:4 * i + 100])) for i in range(30)]  # neighbours alike, ends not
    want = brute(rows)
    assert len({r[2] for r in want}) == 1
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_exact_limit_of_similarity(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:102])), (2, " ".join(w[:87]))]  # 100 and 85 shingles, 85 common
    assert {r[2] for r in run(spark.createDataFrame(rows, "doc_id long, text string"))} == {1}
    rows[1] = (2, " ".join(w[:86]))
    assert {r[2] for r in run(spark.createDataFrame(rows, "doc_id long, text string"))} == {1, 2}


def test_odd_rows(odd, empty):
    assert run(odd) == brute([(r[0], r[1]) for r in odd_rows()])
    assert run(empty) == [] and nd.keep_first(empty).count() == 0


def test_keep_first(odd):
    out = nd.keep_first(odd)
    assert out.columns == odd.columns
    # the near copy of 1 without an id goes, the other row without an id stays
    want = {r[0] for r in brute([(r[0], r[1]) for r in odd_rows()]) if r[3]}
    got = [r.doc_id for r in out.collect()]
    assert set(got) == want and len(got) == len(set(got))
    assert [r.text[:6] for r in out.collect() if r.doc_id is None] == ["lonely"]


def test_a_large_star_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(nd, "STAR", 7)
    rows = list(enumerate(family(3, 60, 150, 3)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_keep_first_by_five_words_and_80_percent(spark):
    base = [f"w{i}" for i in range(204)]  # 200 shingles of five words
    texts = [" ".join(base)] + [" ".join(base + [f"tail{i}x{j}" for j in range(n)]) for i, n in enumerate((20, 30, 40, 49, 50, 51, 60))]
    texts += [" ".join(base[:60] + [f"new{k}x{j}" for j in range(k)] + base[60 + k:]) for k in range(12, 24)]  # one passage replaced
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    want = sorted(set(up))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in nd.keep_first(df, 80, 5).collect())
    assert got == want and 1 < len(want) < len(texts)
    assert got != sorted(r[0] for r in brute(list(enumerate(texts))) if r[3])


def test_bands_for_the_least_similarity():
    assert nd.bands_for(85) == 18 and nd.bands_for(80) == 25 and nd.bands_for(100) == 1
    for percent in range(50, 100):
        assert (1 - (percent / 100) ** nd.ROWS) ** nd.bands_for(percent) <= nd.MISS


def test_an_original_and_many_unlike_copies(spark):
    base, r = [f"w{i}" for i in range(402)], random.Random(11)
    texts = [" ".join(base)]
    for i in range(1000):
        w = list(base)
        for at in r.sample(range(2, 400), 8):
            w[at] = f"new{i}x{at}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    share = lambda a, b: len(a & b) / len(a | b)
    assert min(share(sets[0], s) for s in sets[1:]) >= 0.85
    assert max(share(*r.sample(sets[1:], 2)) for _ in range(3000)) < 0.85
    got = run(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6))
    assert len(got) == 1001 and {x[2] for x in got} == {1}


@pytest.mark.parametrize("rounds, few, block, room", [(0, 0, 512, 1 << 18), (0, 0, 3, 1 << 18), (0, 2, 512, 900), (0, 10 ** 6, 512, 1 << 18), (1, 3, 4, 1 << 18)])
def test_what_the_rounds_leave_is_compared_in_full(spark, monkeypatch, rounds, few, block, room):
    for name, value in (("ROUNDS", rounds), ("FEW", few), ("BLOCK", block), ("BLOCK_SHINGLES", room)):
        monkeypatch.setattr(nd, name, value)
    texts = [t for s, (n, size, edits) in enumerate([(12, 200, 14), (30, 300, 16), (6, 400, 30), (10, 25, 2)]) for t in family(40 + s, n, size, edits)]
    base = words(300, 8).split()
    texts += [" ".join(base[:100 + 9 * i]) for i in range(12)]  # sizes of several steps
    rows = list(enumerate(texts))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_alike_by_sets():
    r = np.random.default_rng(3)
    pool = r.integers(0, 2 ** 64, 12_000, dtype=np.uint64)
    a, b = ([np.unique(r.choice(pool, n)) for n in sizes] for sizes in ((9000, 40, 1, 500), (9000, 41, 12_000)))
    b += [a[3][:425], a[3][:424], a[0][9:]]
    want = [[100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for y in b] for x in a]
    assert nd.alike(a, b, 85).tolist() == want and np.array(want).sum() >= 2


def test_signature_agreement_estimates_similarity():
    ask, r = nd.densification(), np.random.default_rng(2)
    for size in (9, 40, 2000):
        hits = []
        for _ in range(60):
            a = r.integers(0, 2 ** 64, size, dtype=np.uint64)
            b = a.copy()
            b[: max(1, size // 10)] = r.integers(0, 2 ** 64, max(1, size // 10), dtype=np.uint64)
            x, y = nd.signature(np.unique(a), ask), nd.signature(np.unique(b), ask)
            hits.append((x == y).mean())
        k = size - max(1, size // 10)
        assert abs(np.mean(hits) - k / (2 * size - k)) < 0.06


def test_components_by_brute_force(spark):
    r = random.Random(4)
    links = [(bytes([r.randrange(120)]), bytes([r.randrange(120)])) for _ in range(90)] + [(bytes([i]), bytes([i + 1])) for i in range(130, 200)]
    got = {bytes(x.node): bytes(x.label) for x in nd.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    name = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    assert got == {x: v for x, v in name.items() if any(x in e and e[0] != e[1] for e in links)}


def test_long_texts_are_cut_at_words_only():
    t = words(400_000, 6)
    (s,) = nd.shingle_sets(pa.array([t]))
    assert len(s) == len(shingles(t))


def test_large_groups_of_copies_stay_where_they_are(spark):
    """More than a thousandth of all rows in one class: found by the broadcast list of hot keys; the rest by key."""
    from sellerscope.llm import common
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 1000, 'hot', IF(id < 1010, 'cold', concat('k', id))) AS node")
    rows = common.written(rows.unionByName(spark.createDataFrame([(9000, None)], "doc_id long, node string")), "t")
    table = common.written(rows.filter("node IS NOT NULL").groupBy("node").count().withColumnRenamed("count", "n").withColumn("v", F.concat(F.lit("v-"), "node")), "t")
    got = common.lookup(rows, table, "node")
    assert got.columns == ["doc_id", "node", "v"] and got.count() == 3001
    assert got.filter("v <=> concat('v-', node)").count() == 3001
    # neither a third of all rows under one key nor those of ten copies (1 in 300) take part in the join by key
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = common.lookup(rows, table, "node")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_only_rows_that_may_be_wanted_are_dealt_out(spark, kind):
    """All rows of wanted ids pass, null and repeated ones too, and of 3,000 others hardly any; with few bits more pass, never fewer."""
    rows = [(i if kind == "long" else f"d{i}", str(i)) for i in range(3000)]
    rows += [(None, "a"), (None, "b"), rows[5], rows[30]]
    want = [rows[i][0] for i in (0, 5, 30, 31, 2999)] + [None]
    docs = spark.createDataFrame(rows, f"_id {kind}, text string").repartition(4)
    wanted = spark.createDataFrame([(w,) for w in want], f"rep {kind}")
    own = sorted((r for r in rows if r[0] in want), key=str)
    got = [tuple(r) for r in nd.likely(docs, "_id", wanted, "rep").collect()]
    assert sorted((r for r in got if r[0] in want), key=str) == own and len(got) <= len(own) + 3
    few = [tuple(r) for r in nd.likely(docs, "_id", wanted, "rep", 16).collect()]
    assert sorted((r for r in few if r[0] in want), key=str) == own and len(got) < len(few) < len(rows)
    assert nd.likely(docs, "_id", wanted.limit(0), "rep").count() == 0


def test_ids_that_share_marks_change_no_component(spark, monkeypatch):
    rows = list(enumerate(family(3, 20, 150, 3) + [words(50, 900 + i) for i in range(20)]))
    monkeypatch.setattr(nd.likely, "__defaults__", (8,))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)
