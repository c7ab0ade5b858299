"""Writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a run of the loop leaves behind.
ARTIFACTS = (
    "gate_train_split", "gate_eval_split", "gate_model_dir", "gate_metrics", "synthetic_quality_report", "incoming_inference", "review_items", "coverage_analysis", "synthetic_extensions",
    "holdout_inference_before", "holdout_predictions_before", "holdout_metrics_before", "holdout_inference_after", "holdout_predictions_after", "holdout_metrics_after", "summary",
)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_document(rows: list | dict, path: str) -> None:
    """One indented document on the driver, for small results."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")


def write_report(pivot: DataFrame, path: str) -> None:
    """The report as CSV. Many files, one for each partition; a header in each."""
    pivot.write.mode("overwrite").csv(path, header=True)


def write_run(rule_rows: DataFrame, folder: str) -> None:
    """The full report, passed cases, and failed cases with hits in the band; the report is computed once, then read."""
    rule_rows.write.mode("overwrite").parquet(f"{folder}/report")
    report = rule_rows.sparkSession.read.parquet(f"{folder}/report")
    report.filter("passed").write.mode("overwrite").parquet(f"{folder}/passed")
    report.filter(F.size("for_review") > 0).write.mode("overwrite").parquet(f"{folder}/borderline")


def write_split(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(folder)
