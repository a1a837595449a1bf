import struct
import zlib

import corpus_pipeline as cp
import public_tokenizers
from pyspark.sql import functions as F

from sellerscope.llm import common

from .conftest import SF, odd_rows
from .test_classifiers import strange
from .test_decontaminate import brute as leaks
from .test_near_dup import brute as classes


def test_each_stage_against_brute_force(spark, docs):
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    foreign = [(10 ** 6 + i, strange(150, "бвгджзиклмнпрстфхцчшщ", i), None, "src0", 1) for i in range(4)]  # letters, but of no learnt language
    now = docs.unionByName(spark.createDataFrame(foreign, docs.schema))
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, now, SF), "t")
        before = [(r.doc_id, r.text) for r in now.collect()]
        if name != "token_files":
            assert out.columns == docs.columns
            after = [r.doc_id for r in out.collect()]
        if name == "language_id":
            assert sorted(after) == sorted(d for d, t in before if t and any(c.isalpha() for c in t) and d < 10 ** 6)
        elif name == "minhash_near_dedup":
            assert sorted(after) == sorted(r[0] for r in classes(before, 80, 5) if r[3])  # the rule of stages: five words, 80 %
        elif name == "decontaminate":
            assert sorted(after) == sorted(r[0] for r in leaks(before, bench) if not r[5])
        elif name == "mix_sources":
            assert set(after) <= {d for d, _ in before} and max(after.count(d) for d in set(after)) <= 3
        else:
            got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[1])
            assert [r[0] for r in got] == sorted(d for d, _ in before)
            texts = dict(before)
            for d, start, n, crc in got:
                ids = full.encode(texts[d], add_special_tokens=False).ids + [1]
                assert (n, crc) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
        now = out


def test_odd_rows_pass_through(spark, odd, empty):
    for df in (odd, empty):
        now = df
        for _, stage in cp.STAGES:
            now = common.written(stage(spark, now, SF), "t")
        assert set(now.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert now.count() == 0


def test_run_is_the_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "minhash_near_dedup", "decontaminate", "mix_sources", "token_files"] and cp.ORACLE_SQL is None
    assert cp.run(spark, SF).count() > 100
