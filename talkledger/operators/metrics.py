"""Measures of predicted against expected labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import FAIL, PASS


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def classification(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, correct, accuracy, precision, recall, f1 and macro_f1 of rows (expected, predicted), those with an expected label.

    Ratios without a denominator are 0; macro_f1 is the mean over classes that occur among either."""
    e, p = F.col("expected"), F.col("predicted")
    hit = lambda a, b: F.count_if((e == a) & (p == b))
    rows = rows.filter(e.isin(PASS, FAIL))
    a = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(e == p).alias("correct"), hit(PASS, PASS).alias("tp"), hit(FAIL, PASS).alias("fp"), hit(PASS, FAIL).alias("fn"), hit(FAIL, FAIL).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    has_pos, has_neg = ((tp + fp + fn) > 0).cast("int"), ((tn + fp + fn) > 0).cast("int")
    macro = F.coalesce(F.try_divide(_f1(tp, fp, fn) * has_pos + _f1(tn, fn, fp) * has_neg, has_pos + has_neg), F.lit(0.0))
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return a.select(
        *by, "count", "correct", r(F.try_divide("correct", "count")).alias("accuracy"), r(F.try_divide(tp, tp + fp)).alias("precision"),
        r(F.try_divide(tp, tp + fn)).alias("recall"), r(_f1(tp, fp, fn)).alias("f1"), r(macro).alias("macro_f1"),
    )


def with_examples(rows: DataFrame, by: Sequence[str], n: int = 4) -> DataFrame:
    """The measures of each key, and its first n rows (pos, phrase, expected, predicted, score) as examples.

    Which rows these are is decided before the shuffle as well, so a hot key is n rows a task."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    one = F.struct("pos", "phrase", "expected", "predicted", F.round("score", 6).alias("score"))
    listed = rows.filter(F.col("expected").isin(PASS, FAIL)).withColumn("first__", first).filter(F.col("first__") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("examples"))
    return classification(rows, by).join(listed, list(by), "left")


def average_precision(rows: DataFrame) -> DataFrame:
    """ap of rows (label 0 or 1, score): the sum of recall steps times precision over distinct scores; 0 with one class.

    Scores are aggregated first, so the running sums are over distinct scores only."""
    by = rows.groupBy(F.round("score", 6).alias("p")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    out = by.withColumn("tp", F.sum("pos").over(w)).withColumn("seen", F.sum("n").over(w)).withColumn("all_pos", F.sum("pos").over(every)).withColumn("all_n", F.sum("n").over(every))
    both = (F.max("all_pos") > 0) & (F.max("all_pos") < F.max("all_n"))
    ap = F.sum(F.coalesce(F.try_divide(F.col("pos"), F.col("all_pos")), F.lit(0.0)) * F.col("tp") / F.col("seen"))
    return out.agg(F.round(F.when(both, ap).otherwise(F.lit(0.0)), 6).alias("ap"))


def expected_lookup(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """predictions with expected: by (transcript, rule, type, anchor), else by (transcript, rule, anchor), else ''.

    Of repeated keys the last (pos) holds."""
    label = F.max_by("label", "pos").alias("label")
    exact = expected.groupBy("transcript_id", "rule_id", "claim_type", "anchor").agg(label).withColumnRenamed("label", "exact")
    loose = expected.groupBy("transcript_id", "rule_id", "anchor").agg(label).withColumnRenamed("label", "loose")
    out = predictions.join(exact, ["transcript_id", "rule_id", "claim_type", "anchor"], "left").join(loose, ["transcript_id", "rule_id", "anchor"], "left")
    return out.withColumn("expected", F.coalesce("exact", "loose", F.lit(""))).drop("exact", "loose")


def compare_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    """before (transcript_id, rule_id, anchor, label, ver) held against after (the same, ver): by exact key, else by (rule, anchor), else 0.

    Up is better where the label is compliant, down where it isn't; a change within 1e-6 is none."""
    a = after.select("transcript_id", "rule_id", F.lower(F.trim("anchor")).alias("a_anchor"), "ver", "pos")
    exact = a.groupBy("transcript_id", "rule_id", "a_anchor").agg(F.max_by("ver", "pos").alias("exact"))
    loose = a.groupBy("rule_id", "a_anchor").agg(F.max_by("ver", "pos").alias("loose"))
    b = before.withColumn("a_anchor", F.lower(F.trim("anchor")))
    out = b.join(exact, ["transcript_id", "rule_id", "a_anchor"], "left").join(F.broadcast(loose), ["rule_id", "a_anchor"], "left")
    after_score = F.coalesce("exact", "loose", F.lit(0.0))
    delta = F.round(after_score - F.col("ver"), 6)
    better = F.when(F.col("label") == PASS, delta).otherwise(-delta)
    outcome = F.when(better > 1e-6, "improved").when(better < -1e-6, "regressed").otherwise("unchanged")
    return out.select(
        "transcript_id", "rule_id", "anchor", "label", F.col("ver").alias("before_score"), after_score.alias("after_score"), delta.alias("delta"),
        F.when(F.col("label") == PASS, "up").otherwise("down").alias("target_direction"), outcome.alias("outcome"),
    )


def outcome_counts(compared: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = compared.agg(n("improved").alias("improved"), n("unchanged").alias("unchanged"), n("regressed").alias("regressed"))
    return out.withColumn("status", F.when((F.col("regressed") == 0) & (F.col("improved") > 0), "completed").otherwise("needs_more_data"))


def promote(candidate: Column, active: Column) -> Column:
    """Without an active version, or if the candidate is no worse."""
    return active.isNull() | (candidate >= active - 1e-9)


def training_gate(mode: Column, models_exist: Column, metric: Column, threshold: float = 0.9, name: str = "macro_f1") -> Column:
    """status and message of the gate before training: blocked, skipped or ready.

    mode: always trains, never doesn't, anything else trains if the models don't exist. metric: null if there is nothing to measure."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit("if_missing"))))
    trains = (m == "always") | (m != "never") & ~models_exist
    of = lambda status, message: F.struct(F.lit(status).alias("status"), message.alias("message"))
    return (
        F.when((m == "never") & ~models_exist, of("blocked", F.lit("Bootstrap was disabled, but the active retriever/verifier models do not exist yet.")))
        .when(~trains, of("skipped", F.lit("Bootstrap training gate skipped because active models already exist.")))
        .when(metric.isNull(), of("blocked", F.lit("Synthetic dataset is empty, so bootstrap training cannot start.")))
        .when(metric < threshold, of("blocked", F.format_string(f"Synthetic gate failed: {name}=%.4f is below {threshold:.4f}.", metric)))
        .otherwise(of("ready", F.format_string(f"Synthetic gate passed: {name}=%.4f. Full synthetic training completed.", metric)))
    )
