import random
import re

import numpy as np
import pytest
import xxhash

from sellerscope.llm import simhash as sh

from .conftest import odd_rows, words


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """Component per row by all pairs: its smallest id, null last."""
    prints, up = [by_hand(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted(((d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_copies():
    """Copies with few edits of long texts: fingerprints at small distances, in chains too."""
    r, out = random.Random(4), []
    for k in range(6):
        base = words(900, 100 + k).split()
        for c in range(6):
            out.append((100 * k + c + 20, " ".join(base)))
            base[r.randrange(len(base))] = f"edit{k}x{c}"
    return out


@pytest.mark.parametrize("parts,tile", [(4, sh.TILE), (4, 2), (8, 3)])
def test_against_all_pairs(spark, parts, tile):
    rows = [(r[0], r[1]) for r in odd_rows()] + near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in sh.simhash_duplicates(df, parts=parts, tile=tile).collect()), key=str)
    assert got == components(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})  # some fingerprints differ and are linked


def test_odd_and_empty_tables(odd, empty):
    got = {(r.doc_id, r.fingerprint) for r in sh.simhash_duplicates(odd).collect()}
    assert {(d, f) for d, f in got if d in (3, 4, 5)} == {(d, "0" * 16) for d in (3, 4, 5)} and len(got) == len(set(odd_rows()))
    assert sh.simhash_duplicates(empty).count() == 0


def test_long_texts_are_hashed_in_steps(monkeypatch):
    text = (words(4000, 9) + " \n\t" + "x" * 500 + " É ").encode()
    whole = sh.fingerprint(text)
    assert whole & (2 ** 64 - 1) == by_hand(text.decode())
    for step in (1, 7, 100, 5000):
        monkeypatch.setattr(sh, "STEP", step)
        assert sh.fingerprint(text) == whole and sh.fingerprint(b"one two") & (2 ** 64 - 1) == by_hand("one two")


def test_tiles_in_reach_cover_all_close_pairs():
    r = random.Random(1)
    for parts in (4, 8):
        steps, width = set(sh.steps(parts, 3)), 64 // parts
        code = lambda x: sum(((x >> (width * k)) & ((1 << width) - 1)).bit_count() << (sh.FIELD * k) for k in range(parts))
        for _ in range(3000):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), r.randint(0, 3)):
                y ^= 1 << b
            assert code(y) - code(x) in steps or code(x) - code(y) in steps
        assert len(steps) == len(sh.steps(parts, 3)) and min(steps) == 0


def test_forest_keeps_what_is_connected():
    r = np.random.default_rng(2)
    for n, m in ((1, 0), (50, 30), (200, 5000), (300, 299)):
        i, j = (np.arange(n - 1), np.arange(1, n)) if m == n - 1 else r.integers(0, n, (2, m))
        kept = sh.forest(i, j, n)

        def label(i, j):
            up = list(range(n))
            def root(a):
                while up[a] != a:
                    a = up[a]
                return a
            for a, b in zip(i, j):
                up[root(int(a))] = root(int(b))
            names = {}
            return [names.setdefault(root(a), len(names)) for a in range(n)]
        assert label(i, j) == label(i[kept], j[kept]) and len(kept) <= max(0, n - 1)


def test_a_large_family_sends_few_links(spark, monkeypatch):
    """700 fingerprints within reach of one another: less than one link each, although 245,000 pairs are near."""
    r = random.Random(3)
    base = r.getrandbits(63)
    prints = {base} | {base ^ (1 << a) for a in range(63)} | {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 63)}
    found = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    monkeypatch.setattr(sh, "CELLS", 5000)
    links = sh.tiled_links(found).collect()
    near = sum((a ^ b).bit_count() <= 3 for a in prints for b in prints if a < b)
    tiles = len({tuple((p >> 16 * k & 0xFFFF).bit_count() for k in range(4)) for p in prints})
    assert len(links) < 0.2 * near and len(links) <= len(prints) * tiles
    assert all(0 < (x.a ^ x.b).bit_count() <= 3 for x in links)
