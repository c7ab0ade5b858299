"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licences, maxscore, mips, pii, quality, repair, sentencepieces, sharding, simhash, sitetree, warc
from .common import table


def op1_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_norm_bucketed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.report(table(spark, sf_dir, "embeddings"))


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.report(table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def licence_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 8: words, base places and their labels."""
    return op8_licence_scan(spark, sf_dir).drop("labels", "score")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 3: how many base spans of each kind a text has."""
    return op3_pii_sanitisation(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def sharding_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 10: sizes, how far counts are apart, and that slots have no gaps."""
    s = op10_balanced_sharding(spark, sf_dir)
    per = s.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    whole = (F.max("n") - F.min("n") <= 1) & (F.min("shard") >= 0) & (F.max("shard") < 24)
    return per.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), whole.alias("even"), F.bool_and((F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_from_arc": op1_warc_from_arc,
    "op2_norm_bucketed_search": op2_norm_bucketed_search,
    "op3_pii_sanitisation": op3_pii_sanitisation,
    "op4_site_style_tree": op4_site_style_tree,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_licence_scan": op8_licence_scan,
    "op9_decontamination": op9_decontamination,
    "op10_balanced_sharding": op10_balanced_sharding,
    "op11_maxscore_search": op11_maxscore_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
    "licence_base_places": licence_base_places,
    "pii_base_counts": pii_base_counts,
    "sharding_laws": sharding_laws,
}

ORACLES: dict[str, str] = {
    "op1_warc_from_arc": warc.oracle_sql(),
    "op2_norm_bucketed_search": mips.oracle_sql(),
    "op9_decontamination": decontaminate.oracle_sql(),
    "op11_maxscore_search": maxscore.oracle_sql(),
    "licence_base_places": licences.base_sql(),
    "pii_base_counts": pii.base_sql(),
    "sharding_laws": """
        select count(*) as n, cast(sum(octet_length(encode(coalesce(text, ''))) + 8) as bigint) as size, true as even, true as gapless from documents""",
}
