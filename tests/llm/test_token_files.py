import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sellerscope.llm import common, token_files as tf

from .conftest import odd_rows, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


TEXTS = ["Hello, World! it's 12:30 o'clock — don't", "Élan VITAL naïve façade ÿ ß ö÷ø Ø × À", "<|endoftext|> a <|startoftext|>", "<|ENDOFTEXT|> <| x", "ΣΑΣ Σ İstanbul ǅ Ⅷ ½ ²",
         "e\u0301 a \u0301 \u00a0b\u2003c\x85d\x1ce", "漢字かな カナ 😀👍🏽 \u200b", "", " \n\t ", "a'", "''s 's't'll x'dy", "$$$### %%% a|b&c~`^", "\x00\x01\x7f", "ﬁ ﬂ Å Å Ω", "word" * 300]


def test_encoder_equals_the_library_on_whole_texts(full):
    e = tf.Encoder(PATH)
    for t in TEXTS + [words(500, 1), *[r[1] for r in odd_rows() if r[1] and len(r[1]) < 5000]]:
        assert list(struct.iter_unpack("<I", e.text(t.encode()))) == [(i,) for i in full.encode(t, add_special_tokens=False).ids], t


def test_cache_limits_change_nothing(full, monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 20)
    e = tf.Encoder(PATH)
    for i in range(12):
        t = words(60, i % 5) + " it's, odd." 
        assert [x for (x,) in struct.iter_unpack("<I", e.text(t.encode()))] == full.encode(t, add_special_tokens=False).ids


def brute(rows, full):
    out, start = [], 0
    for d, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_against_brute_force(spark, docs, full):
    rows = sorted((r.doc_id, r.text) for r in docs.limit(80).collect()) + [(10 ** 6 + i, t) for i, t in enumerate(TEXTS)] + [(2 * 10 ** 6, None)]
    got = tf.tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, full)


def test_odd_rows(odd, empty, full):
    got = [tuple(r) for r in tf.tokenize(odd, PATH).collect()]
    one = {}
    for r in odd_rows():
        one.setdefault(r[0], []).append(brute([(r[0], r[1])], full)[0][2:])
    assert sorted(((g[0], *g[2:]) for g in got), key=str) == sorted(((k, *x) for k, v in one.items() for x in v), key=str)
    order = sorted(got, key=lambda g: g[1])
    assert [g[1] for g in order] == [sum(x[2] for x in order[:i]) for i in range(len(order))]
    ids = [-1 if g[0] is None else g[0] for g in order]
    assert ids == sorted(ids)
    assert tf.tokenize(empty, PATH).count() == 0


def test_single_documents_are_read_and_damage_is_seen(spark, monkeypatch, full):
    monkeypatch.setattr(tf, "FILE_BYTES", 3000)
    rows = [(i, words(80, i)) for i in range(120)]
    manifest = tf.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), PATH, common.shared_path(spark, "tok"))
    files = manifest.orderBy("part", "seq").collect()
    assert len(files) > 4 and sum(f.n_docs for f in files) == 120
    path = files[1].path
    ((k, doc, before, raw),) = tf.read_file(path, wanted=[2])
    assert k == 2 and [x for (x,) in struct.iter_unpack("<I", raw)] == full.encode(dict(rows)[doc], add_special_tokens=False).ids + [1]
    local = common.open_fs(path)[1]
    data = bytearray(open(local, "rb").read())
    data[len(data) - 9 - 12 * 3 + 8] ^= 1  # a checksum in the seek table
    open(local, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        list(tf.read_file(path))
    import zstandard
    plain = open(common.open_fs(files[0].path)[1], "rb").read()  # an ordinary decoder reads the frames and skips the rest
    assert len(zstandard.ZstdDecompressor().stream_reader(plain, read_across_frames=True).read()) == 4 * files[0].n_tokens


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "string"])
def test_ids_of_other_types(spark, kind):
    df = spark.createDataFrame([(i, words(5, i)) for i in range(7)] + [(None, "x")], "doc_id long, text string")
    got = tf.tokenize(df.withColumn("doc_id", F.col("doc_id").cast(kind)), PATH)
    assert got.schema["doc_id"].dataType.simpleString() == kind
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted([str(i) for i in range(7)] + ["None"])
    with pytest.raises(Exception, match="whole numbers or text"):
        tf.tokenize(df.withColumn("doc_id", F.col("doc_id").cast("double")), PATH).collect()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer that joins words, one with other rules and one with another special token: ids equal the library's."""
    import json
    from tokenizers import Tokenizer
    assert tf.Encoder(PATH).by_word
    spec = json.load(open(PATH))
    cased = spec | {"normalizer": {"type": "NFC"}}
    joined = spec | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    special = spec | {"added_tokens": spec["added_tokens"] + [{**spec["added_tokens"][0], "id": 49408, "content": "hello"}]}
    paths = [public_tokenizers.path("byte_bpe_50k.json")]
    for name, x in (("cased", cased), ("joined", joined), ("special", special)):
        paths.append(str(tmp_path / f"{name}.json"))
        json.dump(x, open(paths[-1], "w"))
    for path in paths:
        e, library = tf.Encoder(path), Tokenizer.from_file(path)
        assert not e.by_word
        for t in TEXTS + ["Say hello to HELLO and  hello!"]:
            assert [i for (i,) in struct.iter_unpack("<I", e.text(t.encode()))] == library.encode(t, add_special_tokens=False).ids, (path, t)
