import re

import pytest
from pyspark.sql import functions as F

from sellerscope.llm import mixing

from .conftest import odd_rows, words


def test_targets_respect_ceiling_and_share(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("d", 3)], "source string, size long")
    t = {r.source: (r.target, r.weight) for r in mixing.source_targets(sizes).collect()}
    assert [t[s][1] for s in ("a", "b", "c", "d", None)] == [5, 2, 1, 5, 2]
    assert t["a"][0] == 30 and t["d"][0] == 9
    left = 2513 - 39
    assert t["b"][0] == pytest.approx(left * 2 / 5) and t["c"][0] == pytest.approx(left / 5) and t[None][0] == pytest.approx(left * 2 / 5)


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rows = [(i, words(1 + i * 7 % 90, i), "en", "abcd"[i % 4] if i % 3 else "a", 1) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = mixing.mix_counts(df.repartition(7)).collect()
    assert sorted(one, key=lambda r: r.doc_id) == sorted(mixing.mix_counts(df.repartition(2)).collect(), key=lambda r: r.doc_id)
    for s in "abcd":
        part = [r for r in one if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 200
    assert all(r.taken <= 3 * r.size for r in one)
    assert mixing.mix(df).count() == sum(r.copies for r in one)


def test_odd_rows(odd, empty):
    got = mixing.mix_counts(odd).collect()
    want = {}
    for r in odd_rows():
        want.setdefault(r[0], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((k, x) for k, v in want.items() for x in v), key=str)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_all_texts_empty(spark):
    df = spark.createDataFrame([(i, "", "en", "a", 0) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.target, r.taken) for r in mixing.mix_counts(df).collect()} == {(0.0, 0)}


def test_main_path_has_no_python(spark, docs):
    plan = mixing.mix_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
