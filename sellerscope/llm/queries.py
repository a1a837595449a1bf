"""The registered queries of this subpackage, one per operator, and the pipeline; their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, langid, mixing, near_dup, pairwise, quality_rules, simhash, suffix_dedup, token_files, urls, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    """Repeated byte strings removed, by merged transforms."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    """Benchmark windows in documents, by suffix arrays."""
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_warc(spark, sf_dir):
    """WARC records written and read back through their index."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op4_mix_sources(spark, sf_dir):
    """Mixing: what the mix takes of each document."""
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark, sf_dir):
    """Quality rules with thresholds from quantile sketches per language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_files(spark, sf_dir):
    """Token ids written in id order and read back."""
    import public_tokenizers  # needed here alone: the other queries work without it
    return token_files.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark, sf_dir):
    """URL rules, then logistic regression on hashed character n-grams."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.labelled_urls(spark)).select(
        "page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark, sf_dir):
    """Quality by pairwise ranking."""
    return pairwise.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate components of documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark, sf_dir):
    """Components of documents whose fingerprints differ in few bits."""
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    """Words with their near words, forms and roots."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark, sf_dir):
    """Distances between sources and the terms that set a source apart."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_decontaminate, op3_warc, op4_mix_sources, op5_quality_rules, op6_token_files, op7_url_filter, op8_quality_classifier, op9_minhash_near_dedup, op10_language_id,
    op11_simhash_near_dedup, op12_spelling_variants, op13_source_divergence)}
ORACLES = {"op3_warc": warc.ORACLE, "op9_minhash_near_dedup": near_dup.ORACLE, "op2_decontaminate": decontaminate.ORACLE, "op4_mix_sources": mixing.ORACLE,
           "op12_spelling_variants": variants.ORACLE, "op13_source_divergence": divergence.ORACLE}
