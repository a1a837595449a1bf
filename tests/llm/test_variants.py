import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sellerscope.llm import variants as va

from .conftest import odd_rows


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows, times=10):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, near = {}, {}
    for w in n:
        close = sorted((-n[v], v) for v in n if one_edit(w, v))
        near[w] = len(close)
        form[w] = close[0][1] if close and -close[0][0] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus():
    """Words with edits of every kind at every place, chains of forms, and ties."""
    r, rows = random.Random(8), []
    for k in range(25):
        w = "".join(r.choice("abcdeé") for _ in range(r.randint(7, 11)))
        rows.append((len(rows), f"{w} " * 200))
        for _ in range(12):
            v = list(w)
            at, kind = r.randrange(len(v) + 1), r.randrange(3)
            if kind == 0:
                v.insert(at, r.choice("abß"))
            elif kind == 1 and at < len(v):
                v[at] = r.choice("xyÿ")
            elif at < len(v):
                del v[at]
            rows.append((len(rows), " ".join(["".join(v).upper() if r.random() < 0.2 else "".join(v)] * r.choice([1, 2, 3, 18]))))
    rows += [(9001, "chained " * 1000), (9002, "chainedx " * 60), (9003, "chainedxy " * 4), (9004, "tiedwora tiedworb " * 40 + "tiedworc " * 2)]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus() + [(r[0], r[1]) for r in odd_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = by_hand(rows)
    get = lambda: sorted((tuple(r) for r in va.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert get() == want
    assert any(r[1] and r[1] != r[2] for r in want)  # a chain of forms
    monkeypatch.setattr(va, "SPLIT", 3)              # every chunk of a few words is dealt out
    monkeypatch.setattr(va, "HELD", 5)
    assert get() == want


def test_each_pair_meets_once(spark):
    words = sorted({w for w in ("abcdefg", "abcdefgh", "xabcdefg", "abcdxefg", "abcdefx", "aabbccdd", "aabbccd", "aaaaaaa", "aaaaaaaa", "aaaaaab")})
    got = [tuple(sorted((r.a, r.b))) for r in va.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_letters_never_hide_an_edit(spark):
    r, pairs = random.Random(5), []
    for _ in range(300):
        a = [chr(r.choice([*range(97, 123), *range(0xC0, 0x100)])) for _ in range(8)]
        b = list(a)
        b[r.randrange(8)] = "ü"
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.filter(F.bit_count(va.letters("a").bitwiseXOR(va.letters("b"))) > 2).count() == 0


def test_long_texts_and_odd_tables(spark, odd, empty, monkeypatch):
    text = ("abcdefgh, " * 5 + "ÀÉÎÕÜßÿ×÷ab-") * 50
    whole = list(x for part in va.runs(text) for x in part)
    for step in (1, 3, 50):
        monkeypatch.setattr(va, "STEP", step)
        assert [x for part in va.runs(text) for x in part] == whole
    assert va.spelling_variants(empty).count() == 0
    assert va.spelling_variants(odd).columns == ["word", "form", "root", "n", "n_near", "form_n"]
