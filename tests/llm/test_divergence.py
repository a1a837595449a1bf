import random
import re
from collections import Counter, defaultdict

import pytest

from sellerscope.llm import divergence as dv

from .conftest import odd_rows

NAMES = "doc_id long, text string, lang string, source string"


def by_hand(rows, least=10, ranks=10):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        docs[lang].update(set(t))
        count[lang, source].update(t)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10 ** 9 * (c[t] + 2)) // (total + 2 * len(kept)) for t in kept}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pair, len(pair)), ("term", term, ranks)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:top], 1):
                    out.append((lang, s, part, item, -v, rank))
    return sorted(out)


def corpus():
    r, rows = random.Random(6), []
    vocab = ["a", "The", "été", "漢字", "ÿ", "x"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(4)]
    for lang, sources in (("en", "abcde"), ("de", "ab"), ("fr", "a"), (None, "ab")):
        for s in sources:
            for _ in range(14):
                rows.append((" ".join(r.choice(vocab[:8 + 5 * (ord(s) - 96)]) + r.choice([" ", "1", ",", "\n"]) for _ in range(r.randint(0, 40))), lang, s))
    return rows + [(None, "en", "z"), ("", "xx", "one"), ("rare words", "xx", "two"), ("!!!", "xx", None)] + [(t, x, s) for _, t, x, s, _ in odd_rows()]


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_against_brute_force_with_shared_digests(spark, bits):
    rows = corpus()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], NAMES).repartition(4)
    assert sorted(tuple(r) for r in dv.source_divergence(df, bits=bits).collect()) == by_hand(rows)


def test_large_tables_are_not_broadcast_whole(spark, monkeypatch):
    monkeypatch.setattr(dv, "SMALL", 2)
    monkeypatch.setattr(dv, "HELD", 5)
    rows = corpus()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], NAMES).repartition(4)
    assert sorted(tuple(r) for r in dv.source_divergence(df).collect()) == by_hand(rows)


def test_terms_cross_the_shuffle_as_digests(spark):
    """The counts are exchanged by (lang, source, digest); the term itself is not in that exchange."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(corpus())], NAMES)
    terms = dv.task_counts(df.na.fill(""))
    from pyspark.sql import functions as F
    plan = terms.withColumn("digest", F.xxhash64("term")).groupBy("lang", "source", "digest").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning")
    assert "term" not in above and "digest" in above and "xxhash64(term" in below


def test_odd_and_empty_tables(odd, empty, monkeypatch):
    assert dv.source_divergence(empty).count() == 0
    got = dv.source_divergence(odd).collect()
    assert {(r.lang, r.source) for r in got} >= {("en", "a"), ("de", "b")} and all(r.part == "pair" and r.value == 0 for r in got if r.lang == "de")
    text = ("Abc dÉf-" * 300).encode()
    whole = [t for part in dv.term_lists(text) for t in part]
    monkeypatch.setattr(dv, "STEP", 5)
    assert [t for part in dv.term_lists(text) for t in part] == whole


def test_least_and_greatest_strings_are_taken_of_distinct_terms(spark, monkeypatch):
    """Sorting for the least string of a digest comes after the terms are made distinct by hash, not over all counts."""
    from sellerscope.llm import divergence as dv
    plans, plain = {}, dv.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)
    monkeypatch.setattr(dv, "written", seen)
    docs = spark.createDataFrame([("en", "a", "one two one")] * 12 + [("en", "b", "two three")] * 11, "lang string, source string, text string")
    kept, _, names = dv.counted(docs)
    assert sorted(r.term for r in names.collect()) == ["one", "three", "two"] and kept.count() == 3
    assert re.search(r"Aggregate \[(digest|term)#\w+, (digest|term)#\w+\]", plans["names"])  # none before
