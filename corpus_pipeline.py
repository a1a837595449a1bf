"""The training-data pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sellerscope.llm import common, decontaminate, langid, mixing, near_dup, token_files


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter go, and those in no learnt language by a limit of their size.

    Null and empty text: without a letter.  Very long texts are judged whole; repeated rows alike.  Empty table: no rows."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words and a similarity of 80 %.

    Rows of null, empty or wordless text stay; of repeated rows one stays; very long texts are compared whole.  Empty
    table: no rows."""
    return near_dup.keep_first(docs, 80, 5)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null or empty text has none; very long texts are searched whole; repeated rows are judged alike.  Empty table: no rows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null source: one of its own.  Null or empty text: size 0, taken like its neighbours by size.  Repeated rows are rows of
    their own.  Empty table: no rows."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in id order, read back: doc_id, start, n_tokens, ids_crc32.

    Null or empty text: the end id alone.  Very long texts are encoded whole.  Repeated rows and equal ids: one entry each.
    Empty table: no rows."""
    import public_tokenizers  # needed here alone
    return token_files.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_languages), ("minhash_near_dedup", drop_near_duplicates), ("decontaminate", decontaminate_benchmark),
          ("mix_sources", mix_sources), ("token_files", write_tokens)]

#: A learnt model and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; returns the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
