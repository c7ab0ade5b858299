"""Rules in JSON to claims. An anchor is a text, or groups of texts; types are told apart by VARIANT."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip


def parse_rules(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row for each rule of a JSON object of rules, in order; entries that are no objects are skipped."""
    rows = documents.select(F.posexplode(F.from_json(F.col(column), "map<string,string>")).alias("rule_pos", "rule_id", "raw"))
    v = F.try_parse_json("raw")
    rows = rows.withColumn("v", v).filter(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda name: strip(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))
    anchor = F.try_variant_get("v", "$.anchor", "variant")
    fields = {"Theme": "theme", "Description": "description", "Purpose_of_control": "purpose", "Criteria": "criteria"}
    return rows.select("rule_id", *[text(k).alias(c) for k, c in fields.items()], F.try_variant_get("v", "$.Keywords", "variant").alias("keywords"), anchor.alias("anchor"), "rule_pos")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.text(path, wholetext=True))


def select_rules(rules: DataFrame, include: Collection[str] | None = None, exclude: Collection[str] = ()) -> DataFrame:
    """Nothing to include means all; what is excluded goes in any case."""
    out = rules.filter(F.col("rule_id").isin(*include)) if include else rules
    return out.filter(~F.col("rule_id").isin(*exclude)) if exclude else out


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def claims(rules: DataFrame) -> DataFrame:
    """claim_id, rule_id, claim_type, claim_ord, anchor: the claims of all rules, numbered from 0 in their order.

    An anchor with groups gives its mandatory, then its standard texts, blank ones skipped, claim_ord being the
    place in the group; a text gives a single claim. What is left without any falls back to the criteria.
    A list of texts is an error: it has no type."""
    kind = _kind(F.col("anchor"))
    texts = lambda group: F.try_variant_get("anchor", f"$.{group}", "array<variant>")
    entry = lambda group, n: lambda v, i: F.struct(F.lit(n).alias("n"), F.lit(group).alias("claim_type"), i.alias("claim_ord"), F.when(_kind(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))).alias("anchor"))
    none = F.array().cast("array<struct<n:int,claim_type:string,claim_ord:int,anchor:string>>")
    grouped = F.concat(F.coalesce(F.transform(texts("mandatory"), entry("mandatory", 0)), none), F.coalesce(F.transform(texts("standard"), entry("standard", 1)), none))
    single = F.array(F.struct(F.lit(0).alias("n"), F.lit("single").alias("claim_type"), F.lit(0).alias("claim_ord"), strip(F.try_variant_get("anchor", "$", "string")).alias("anchor")))
    wrong = F.raise_error(F.concat(F.lit("the anchor of rule "), F.col("rule_id"), F.lit(" is a list"))).cast("array<struct<n:int,claim_type:string,claim_ord:int,anchor:string>>")
    found = F.when(kind.startswith("OBJECT"), grouped).when(kind.startswith("ARRAY"), wrong).when(kind == "VOID", none).otherwise(single)
    found = F.filter(found, lambda c: F.coalesce(c["anchor"], F.lit("")) != "")
    fallback = F.when(F.col("criteria") != "", F.array(F.struct(F.lit(0).alias("n"), F.lit("single").alias("claim_type"), F.lit(0).alias("claim_ord"), F.col("criteria").alias("anchor")))).otherwise(none)
    rows = rules.withColumn("found", found).select("rule_id", "rule_pos", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(fallback)).alias("c"))
    order = Window.orderBy("rule_pos", "c.n", "c.claim_ord")  # a few rows for each rule: rules are configuration
    return rows.select((F.row_number().over(order) - 1).alias("claim_id"), "rule_id", "c.claim_type", "c.claim_ord", "c.anchor")


def rubric(rules: DataFrame) -> DataFrame:
    """rule_id, description, rubric: what a reviewer is told."""
    texts = F.filter(F.transform(F.try_variant_get("anchor", "$.mandatory", "array<string>"), strip), lambda t: t != "")
    listed = F.when(_kind(F.col("anchor")).startswith("OBJECT"), F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n"))
    listed = F.coalesce(listed.otherwise(F.concat(F.lit("- "), F.coalesce(strip(F.try_variant_get("anchor", "$", "string")), F.lit("")))), F.lit(""))
    text = F.concat(F.lit("Description: "), "description", F.lit("\nPurpose: "), "purpose", F.lit("\nCriteria: "), "criteria", F.lit("\nAnchor meanings that count as compliant:\n"), listed)
    return rules.select("rule_id", "description", text.alias("rubric"))


def resolve_anchor(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with resolved: the explicit anchor, else the rule's text, else the text of its groups (mandatory,
    then standard) or list at prompt_index; a list of one needs no index. Null if there is none."""
    kind = _kind(F.col("anchor"))
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), strip), lambda t: F.coalesce(t, F.lit("")) != "")
    of_groups = F.concat(clean(F.try_variant_get("anchor", "$.mandatory", "array<string>")), clean(F.try_variant_get("anchor", "$.standard", "array<string>")))
    lookup = rules.select(
        F.col("rule_id").alias("r_id"),
        F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.nullif(strip(F.try_variant_get("anchor", "$", "string")), F.lit(""))).alias("r_text"),
        F.when(kind.startswith("OBJECT"), of_groups).alias("r_groups"),
        F.when(kind.startswith("ARRAY"), clean(F.try_variant_get("anchor", "$", "array<string>"))).alias("r_list"),
    )
    index = F.col("prompt_index").try_cast("int")
    at = lambda a: F.when(index >= 0, F.get(a, index))
    resolved = F.coalesce(
        F.nullif(strip(F.col("anchor")), F.lit("")), "r_text", at(F.col("r_groups")), at(F.col("r_list")), F.when(index.isNull() & (F.size("r_list") == 1), F.get("r_list", F.lit(0)))
    )
    out = rows.join(F.broadcast(lookup), strip(rows["disclaimer_id"].cast("string")) == F.col("r_id"), "left")
    return out.withColumn("resolved", resolved).drop("r_id", "r_text", "r_groups", "r_list")


def prompts(documents: DataFrame, column: str = "value") -> DataFrame:
    """rule_id, scenario, prompt_index, system_instruction, user_prompt of a prompt configuration; scenarios ending in _qa are skipped."""
    rules = documents.select(F.posexplode(F.from_json(F.col(column), "map<string,string>")).alias("r_pos", "rule_id", "r"))
    scenes = rules.select("r_pos", "rule_id", F.posexplode(F.from_json("r", "map<string,string>")).alias("s_pos", "scenario", "s")).filter(~F.col("scenario").endswith("_qa"))
    v = F.try_parse_json("s")
    one = F.try_variant_get("v", "$.user_prompt", "variant")
    listed = F.when(_kind(one) == "STRING", F.array(F.try_variant_get("v", "$.user_prompt", "string"))).when(_kind(one).startswith("ARRAY"), F.try_variant_get("v", "$.user_prompt", "array<string>"))
    listed = F.filter(listed, lambda p: strip(F.coalesce(p, F.lit(""))) != "")
    out = scenes.withColumn("v", v).select("rule_id", "scenario", F.coalesce(F.try_variant_get("v", "$.system_instruction", "string"), F.lit("")).alias("system_instruction"), F.posexplode(listed).alias("prompt_index", "user_prompt"))
    return out
