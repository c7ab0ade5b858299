"""Review queues, labels and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions.text import collapse, confidence, strip

#: The band of the interactive queues is fixed, whatever the settings say.
QUEUE_LOW, QUEUE_HIGH = 0.30, 0.70


def in_band(score: Column, low: float = QUEUE_LOW, high: float = QUEUE_HIGH) -> Column:
    return (score >= low) & (score < high)


def borderline(claim_rows: DataFrame, low: float = QUEUE_LOW, high: float = QUEUE_HIGH) -> DataFrame:
    return claim_rows.filter(in_band(F.col("ver"), low, high)).select("transcript_id", "rule_id", "claim_type", "anchor", "text", "retr", "ver", F.col("claim_id").alias("claim_order"))


def first_of(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. A hot key's rows are reduced on each task's side before the shuffle."""
    return df.withColumn("first__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("first__ = 1").drop("first__")


def review_items(claim_rows: DataFrame) -> DataFrame:
    """Passed or borderline claims, once for each transcript, rule, type, anchor and text."""
    rows = claim_rows.filter(F.col("passed") | in_band(F.col("ver")))
    rows = first_of(rows, [F.col(c) for c in ("transcript_id", "rule_id", "claim_type", "anchor", "text")], [F.col("claim_id")])
    return rows.select(
        "transcript_id", "rule_id", "claim_type", "anchor", "text", "retr", "ver", F.col("claim_id").alias("claim_order"),
        F.when(in_band(F.col("ver")), "borderline").otherwise("pass").alias("review_type"), F.when(F.col("passed"), L.PASS).otherwise(L.FAIL).alias("model_label"),
    )


def review_units(claim_rows: DataFrame, role: str, low: float, high: float) -> DataFrame:
    """Every claim with its bucket and an id: role:transcript:rule:group:order."""
    order = F.row_number().over(Window.partitionBy("transcript_id", "rule_id", "claim_type").orderBy("claim_id")) - 1
    rows = claim_rows.withColumn("group_order", order)
    bucket = F.when(in_band(F.col("ver"), low, high), "borderline").when(F.col("passed"), "pass").otherwise("fail")
    return rows.select(
        F.concat_ws(":", F.lit(role), "transcript_id", "rule_id", "claim_type", F.col("group_order").cast("string")).alias("review_id"), F.lit(role).alias("dataset_role"),
        "transcript_id", "rule_id", "claim_type", "anchor", "text", "retr", "ver", F.col("claim_id").alias("claim_order"), bucket.alias("review_bucket"),
        F.when(F.col("passed"), L.PASS).otherwise(L.FAIL).alias("model_label"),
    )


def label_items(items: DataFrame, answer: Column | None = None, default: float = 0.0) -> DataFrame:
    """items with llm_label, llm_confidence, source. A keyword override wins over the reviewer's answer (JSON text with label and confidence)."""
    rule = L.keyword_override(F.col("anchor"), F.col("text"))
    given = answer if answer is not None else F.lit(None).cast("string")
    llm = F.nullif(L.normalise(F.get_json_object(given, "$.label"), "reviewer"), F.lit(""))
    sure = confidence(F.get_json_object(given, "$.confidence"), default, 0.75)
    label = F.coalesce(rule, llm, F.lit(""))
    known = F.get_json_object(given, "$.confidence").isNotNull()
    conf = F.when(known, sure).when(rule.isNotNull(), F.lit(0.70)).when(llm.isNotNull(), F.lit(0.55)).otherwise(F.lit(0.0))
    return items.withColumn("llm_label", label).withColumn("llm_confidence", conf).withColumn("label_source", F.when(rule.isNotNull(), "keyword").when(llm.isNotNull(), "reviewer").otherwise("none"))


def finalize(items: DataFrame, auto_approve: bool = True) -> DataFrame:
    """Blank texts are non-compliant without asking; the rest keep the reviewer's label."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    label = F.when(blank, F.lit(L.FAIL)).otherwise(F.col("llm_label"))
    out = items.withColumn("llm_confidence", F.when(blank, F.lit(0.75)).otherwise(F.col("llm_confidence"))).withColumn("llm_label", label)
    usable = F.col("llm_label").isin(L.PASS, L.FAIL)
    return (
        out.withColumn("prediction_matches_review", F.col("llm_label") == F.col("model_label"))
        .withColumn("auto_approved", usable & F.lit(auto_approve))
        .withColumn("final_label", F.when(usable & F.lit(auto_approve), F.col("llm_label")).otherwise(F.lit("")))
    )


def expected_label(final: Column, reviewer: Column) -> Column:
    ok = lambda x: F.when(x.isin(L.PASS, L.FAIL), x)
    return F.coalesce(ok(final), ok(reviewer), F.lit(""))


def needs_human(review_type: Column, reviewer: Column) -> Column:
    return (review_type == "borderline") | ((review_type == "pass") & (reviewer == L.FAIL))


def disagreement(final: Column, reviewer: Column, model: Column, score: Column) -> Column:
    label = F.coalesce(F.nullif(final, F.lit("")), F.nullif(reviewer, F.lit("")), F.lit(""))
    own = F.coalesce(F.nullif(L.normalise(model, "review"), F.lit("")), L.from_score(F.coalesce(score, F.lit(0.0))))
    return label.isin(L.PASS, L.FAIL) & (own != label)


def to_compare(review_type: Column, final: Column, reviewer: Column, model: Column, score: Column) -> Column:
    kind = F.lower(strip(F.coalesce(review_type, F.lit(""))))
    label = F.coalesce(F.nullif(final, F.lit("")), F.nullif(reviewer, F.lit("")), F.lit(""))
    return (kind != "generated_synthetic") & label.isin(L.PASS, L.FAIL) & ((kind == "borderline") | disagreement(final, reviewer, model, score))


def training_key(rule: Column, anchor: Column, dialogue: Column, kind: Column, dialect: str | None = None) -> list[Column]:
    """The four parts of a training row's identity. dialect: normalise the type too."""
    t = L.normalise(kind, dialect) if dialect else F.lower(strip(F.coalesce(kind, F.lit(""))))
    return [F.lower(strip(F.coalesce(rule, F.lit("")))), collapse(anchor, lower=True), collapse(dialogue, lower=True), t]


def approve(items: DataFrame, existing: DataFrame | None = None, weight: int = 3) -> DataFrame:
    """Training rows of approved items with a usable label, less those that exist, once each."""
    label = L.normalise(F.coalesce(F.nullif(F.col("final_label"), F.lit("")), F.col("llm_label")), "review")
    rows = items.filter(F.coalesce(F.col("approved"), F.lit(True))).withColumn("label", label).filter("label <> ''")
    generated = F.lower(F.coalesce("review_type", F.lit(""))) == "generated_synthetic"
    rows = rows.select(
        F.col("rule_id").alias("disclaimer_id"), "anchor", F.col("text").alias("dialogue"), F.when(F.col("label") == L.PASS, "compliant").otherwise("non-compliant").alias("type"),
        F.when(generated, 1).otherwise(weight).alias("sample_weight"), F.when(generated, "generated").otherwise("human_review").alias("source"), "row_pos",
    )
    key = training_key(F.col("disclaimer_id"), F.col("anchor"), F.col("dialogue"), F.col("type"))
    keyed = rows.withColumns({f"k{n}": k for n, k in enumerate(key)})
    names = [f"k{n}" for n in range(4)]
    keyed = first_of(keyed, [F.col(k) for k in names], [F.col("row_pos")])
    if existing is not None:
        old = existing.select(*[k.alias(f"k{n}") for n, k in enumerate(training_key(F.col("disclaimer_id"), F.col("anchor"), F.col("dialogue"), F.col("type")))]).distinct()
        keyed = keyed.join(old, names, "left_anti")
    return keyed.drop(*names)


def readiness(rows: DataFrame) -> DataFrame:
    """count, labels present and missing, ready: both labels are needed to train."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("type")).alias("present"))
    missing = F.array_except(F.array(F.lit("compliant"), F.lit("non-compliant")), "present")
    return out.select("n", F.array_join("present", ",").alias("present"), F.array_join(missing, ",").alias("missing"), ((F.col("n") > 0) & (F.size(missing) == 0)).alias("ready"))


def refresh_queue(queue: DataFrame, generated: DataFrame, key: list[str]) -> DataFrame:
    """The queue without old generated rows, and new generated ones whose identity it lacks, once each."""
    kept = queue.filter("review_type <> 'generated_synthetic'")
    fresh = first_of(generated, [F.col(k) for k in key], [F.col("row_pos")]).join(kept.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(fresh)
