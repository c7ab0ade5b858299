"""Generated snippets: filter, judge, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import single_turn, strip, word_count

#: Role tags that a single-speaker snippet must not hold.
ROLE_TAGS = ("client:", "rm:", "advisor:", "agent:")


def judged_snippets(answers: DataFrame, min_words: int = 5, max_words: int = 60) -> DataFrame:
    """answers (answer_id, answer: a JSON array) exploded: pos, label, text, reason. reason is the first check that failed, or kept."""
    rows = answers.select("answer_id", F.posexplode(F.from_json("answer", "array<string>")).alias("pos", "raw"))
    v = F.try_parse_json("raw")
    keys = F.array_sort(F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))
    is_text = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING"
    rows = rows.withColumn("v", v).withColumn("keys", keys)
    label, text = F.try_variant_get("v", "$.label", "string"), F.try_variant_get("v", "$.text", "string")
    rows = rows.withColumn("label", strip(label)).withColumn("text", single_turn(text))
    tagged = F.lit(False)
    for t in ROLE_TAGS:
        tagged = tagged | F.contains(F.lower("text"), F.lit(t))
    shaped = (F.col("keys") == F.array(F.lit("label"), F.lit("text"))) & F.coalesce(is_text("label"), F.lit(False)) & F.coalesce(is_text("text"), F.lit(False))
    n = word_count(F.col("text"))
    reason = (
        F.when(~shaped, "schema").when(~F.col("label").isin("Compliant", "Non-Compliant"), "label").when(tagged, "multi_speaker").when(n < min_words, "too_short").when(n > max_words, "kept_long").otherwise("kept")
    )
    return rows.select("answer_id", "pos", F.when(shaped, F.col("label")).alias("label"), F.when(shaped, F.col("text")).alias("text"), reason.alias("reason"))


def snippet_stats(judged: DataFrame) -> DataFrame:
    n = lambda *r: F.count_if(F.col("reason").isin(*r))
    return judged.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("input_len"), n("kept", "kept_long").alias("kept"), n("schema").alias("dropped_schema"), n("label").alias("dropped_label"),
        n("multi_speaker").alias("dropped_multi_speaker"), n("too_short").alias("dropped_too_short"), n("kept_long").alias("kept_too_long"),
    )


def judge_accepts(judgement: Column, least: int = 9) -> Column:
    v = F.try_parse_json(judgement)
    return F.coalesce(F.try_variant_get(v, "$.pass", "boolean") & (F.try_variant_get(v, "$.score", "double") >= least), F.lit(False))


def remaining(prompts: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts whose (rule, scenario, index) has no output yet."""
    return prompts.join(done.select("rule_id", "scenario", "prompt_index").distinct(), ["rule_id", "scenario", "prompt_index"], "left_anti")
