import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sellerscope.llm import langid, pairwise, queries as q

from .conftest import SF, odd_rows, words


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = q.QUERIES["op10_language_id"](spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in both if r.held_out]
    assert len(both) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in both)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in both)


def test_language_odd_rows(odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    assert by[7].lang_pred in ("en", "de") and langid.identify(empty).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert langid.keep_identified(empty).count() == 0


def test_no_labels_at_all(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)] * 2


def test_document_frequencies_and_features(spark):
    texts = ["abc abd", "abc", "123", None, "ABC"]
    letters = langid.letter_table()
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    want = sum(((langid.gram_counts(t, letters) > 0).astype(int) for t in ("abc abd", "abc", "abc")), np.zeros(langid.BUCKETS, int))
    assert n == 3 and (df == want).all()
    at, x = langid.unit_features(langid.gram_counts("abc abd", letters), np.ones(langid.BUCKETS, np.float32))
    assert abs(float(x @ x) - 1) < 1e-5


def test_long_texts_count_like_short_pieces(monkeypatch):
    t, letters = words(3000, 5), langid.letter_table()
    whole = langid.gram_counts(t, letters)
    assert whole.sum() > 3 * len(t) * 0.9
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert (langid.gram_counts(t, letters) == whole).all()
    odd = "a1 22 b—c  Σ.ΑΣ İx \n" * 200 + "…" * 50 + "zz"
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "PIECE", 1 << 20)
        whole = langid.gram_counts(odd, letters)
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.gram_counts(odd, letters) == whole).all()
    assert langid.gram_counts("12 … 3", letters) is None


def test_many_repeats_of_a_gram_are_learnt_from_in_full(spark):
    df = spark.createDataFrame([(i, ("ab" * 70_000) if i == 1 else "some text", "en") for i in range(1, 9)], "doc_id long, text string, lang string")
    counts = [np.frombuffer(r["n"], np.int64).max() for r in langid.labelled_sample(df)]
    assert max(counts) >= 70_000


def test_scores_against_a_plain_scorer(spark, docs):
    """The same weights, in plain Python over dictionaries."""
    import math
    model, letters = langid.fit_languages(langid.training_rows(docs)), langid.letter_table()
    got = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        counts = {i: int(c) for i, c in enumerate(langid.gram_counts(r.text, letters)) if c}
        x = {i: math.log1p(c) * float(model.idf[i]) for i, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        s = [(sum(v / norm * float(model.weights[i][k]) for i, v in x.items()) + float(model.bias[k])) / model.temp for k in range(len(model.langs))]
        p = [math.exp(v - max(s)) / sum(math.exp(u - max(s)) for u in s) for v in s]
        assert got[r.doc_id].lang_pred == model.langs[p.index(max(p))] and abs(got[r.doc_id].score - max(p)) < 1e-3


def strange(n, letters, seed):
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(n))


def test_long_texts_of_no_learnt_language_go_and_clean_ones_stay(spark, docs):
    junk = [(10 ** 6 + i, strange(200, "бвгджзиклмнпрстфхцчшщ", i), None, "x", 1) for i in range(5)]
    junk += [(2 * 10 ** 6 + i, strange(200, "ぁあいうえおかきくけこさしすせそ", i), None, "x", 1) for i in range(5)]
    short = [(3 * 10 ** 6, "бвг джз", None, "x", 1)]
    both = docs.unionByName(spark.createDataFrame(junk + short, docs.schema))
    kept = {r.doc_id for r in langid.keep_identified(both).collect()}
    assert not kept & {j[0] for j in junk} and short[0][0] in kept
    assert {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} <= kept


def test_short_texts_are_scored_and_held_to_a_limit_of_their_size(spark, docs):
    letters = ("бвгджзиклмнпрстфхцчшщ", "ぁあいうえおかきくけこさしすせそ")
    junk = [(10 ** 6 + i, strange(16, letters[i % 2], i), None, "x", 1) for i in range(10)]  # under LONG grams: kept unscored before
    clean = [(2 * 10 ** 6 + i, r.text[:n], None, "x", 1) for i, (r, n) in enumerate((r, n) for r in docs.orderBy("doc_id").limit(8).collect() for n in (60, 150))]
    clean = [x for x in clean if any(c.isalpha() for c in x[1])]
    assert all(langid.gram_counts(x[1], langid.letter_table()).sum() < langid.LONG for x in junk + clean)
    both = docs.unionByName(spark.createDataFrame(junk + clean, docs.schema))
    kept = {r.doc_id for r in langid.keep_identified(both).collect()}
    assert not kept & {x[0] for x in junk} and {x[0] for x in clean} <= kept
    assert {r.doc_id for r in langid.keep_identified(both, min_score=1.1).collect()} == set()


def test_limits_of_short_texts_follow_the_size(docs):
    model = langid.fit_languages(langid.training_rows(docs))
    assert len(model.short) == langid.LONG.bit_length() + 1 and model.short == sorted(model.short)
    assert 0 < model.short[5] <= model.short[-1] <= model.floor
    assert langid.short_limits([], model) == [0.0] * len(model.short)
    counts = langid.gram_counts("the name of the rose", langid.letter_table())
    assert langid.language(counts, model)[0] in model.langs and langid.language(None, model) == ("und", 0.0)
    assert langid.least_score(counts, model) == model.short[int(counts.sum()).bit_length()]


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(0)
    ex = []
    for i in range(300):
        y = i % 3
        at = np.unique(np.concatenate([r.integers(0, 20000, 15), 100 + 10 * y + r.integers(0, 10, 5)]))
        ex.append((at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32), y))
    w, b = langid.ftrl(ex, 3)
    assert np.mean([int((x @ w[at] + b).argmax()) == y for at, x, y in ex]) > 0.97
    assert (w == 0).mean() > 0.6
    s = np.array([x @ w[at] + b for at, x, _ in ex])
    t = langid.temperature(s * 7, np.array([y for *_, y in ex]))
    assert abs(t / langid.temperature(s, np.array([y for *_, y in ex])) - 7) < 0.8


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = q.QUERIES["op8_quality_classifier"](spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert got.count() == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in both)
    held = [r for r in both if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in both)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, None, 0), (None, 1, 0), (9, 0, 1), (11, 1, 1), (11, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    got = pairwise.score_documents(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert pairwise.score_documents(empty, labels).count() == 0
    assert {r.score for r in pairwise.score_documents(odd, labels.limit(0)).collect()} == {0.7}


def test_text_features():
    x = dict(zip(pairwise.FEATURES, pairwise.text_features(pa.array(["AB ab ab ab 1!\nx\nx\n"]))[0]))
    assert x["upper"] == 2 / 19 and x["line"] == 3 / 19 and x["caps_share"] == 2 / 10
    assert x["next_word_same"] == 4 / 6 and x["dup_lines"] == 1 - 2 / 3
    assert not pairwise.text_features(pa.array([None, ""], pa.string())).any()


def test_pairs_recover_the_order():
    r = np.random.default_rng(3)
    true = np.array([2.0, -1.0, 0.0, 0.5])
    x = r.normal(size=(600, 4))
    s = x @ true
    w = pairwise.fit_pairs(x[s > 0.5], x[s < -0.5])
    assert np.corrcoef(x @ w, s)[0, 1] > 0.97
