"""The registered training-data queries and their SQL twins, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import chat_format, decontaminate, jaccard_join, language_id, packing, piece_counts, prefix_trie, quality_ledger, sentencepiece_bpe, structure_repair, substring_dedup, url_lists, warc_convert
from plinth.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_report(table(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(table(spark, sf_dir, "documents"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(table(spark, sf_dir, "conversations"))


@query
def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.quality_report(table(spark, sf_dir, "documents"))


ORACLES |= {"op8_chat_format": chat_format.REPORT_SQL, "op10_quality_ledger": quality_ledger.REPORT_SQL}


@query
def op1_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_convert.warc_report(table(spark, sf_dir, "pages"))


ORACLES["op1_warc_convert"] = warc_convert.REPORT_SQL


@query
def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.url_report(table(spark, sf_dir, "pages"))


ORACLES["op2_url_lists"] = url_lists.REPORT_SQL


@query
def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


@query
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.ablation_report(table(spark, sf_dir, "documents"))


ORACLES["rule_ablations"] = quality_ledger.ABLATION_SQL


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_report(table(spark, sf_dir, "conversations"))
