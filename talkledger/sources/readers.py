"""Readers. Paths may be anything that Spark opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.labels import FAIL, PASS
from ..functions.text import pass_labels, strip
from ..operators import segment


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, wherever Spark reads from; other errors are raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """transcript_id, transcript of each *.txt: the id is the file's name; empty ones are left out."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    raw = raw.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("transcript_id"), F.col("value").alias("transcript"))
    return segment.plain_text(raw).filter("transcript <> ''")


def read_structured_folder(spark: SparkSession, folder: str) -> DataFrame:
    """transcript_id, sca, client of each *.txt with diarised headers."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return segment.structured_sides(raw.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("transcript_id"), F.col("value").alias("transcript")))


def _identified(rows: DataFrame) -> DataFrame:
    """Rows with a transcript; a missing id is made of the place in the file."""
    rows = rows.select("*", F.coalesce(F.nullif(strip(F.col("raw_id")), F.lit("")), F.concat(F.lit("transcript_"), (F.col("pos") + 1).cast("string"))).alias("transcript_id"))
    return rows.filter(strip(F.coalesce("transcript", F.lit(""))) != "")


def read_json_transcripts(spark: SparkSession, path: str, role: str = "incoming") -> DataFrame:
    """transcript_id, title, transcript, dataset_role of a JSON array of objects; others are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "one"))
    fields = F.from_json("one", "transcript_id string, title string, transcript string")
    rows = raw.select("pos", fields.alias("f")).select("pos", F.col("f.transcript_id").alias("raw_id"), F.coalesce("f.title", F.lit("")).alias("title"), "f.transcript")
    out = _identified(rows).select("transcript_id", "title", "transcript", F.lit(role).alias("dataset_role"))
    if out.isEmpty():
        raise ValueError(f"{path}: no transcripts")
    return out


def read_incoming(spark: SparkSession, path: str) -> DataFrame:
    """A folder of texts, a .json, or one .txt."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        return read_json_transcripts(spark, path)
    if path.endswith(".txt") or _is_folder(spark, path):
        raw = read_text_folder(spark, path) if not path.endswith(".txt") else segment.plain_text(
            spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("transcript_id"), F.col("value").alias("transcript"))
        )
        return raw.select("transcript_id", F.col("transcript_id").alias("title"), "transcript", F.lit("incoming").alias("dataset_role"))
    raise ValueError(f"{path}: neither a folder nor .json or .txt")


def valid_expected(labels: Column) -> Column:
    """Expected labels with a known label, a rule and an anchor."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    return F.filter(F.coalesce(labels, F.array().cast(schemas.EXPECTED)), lambda e: e["label"].isin(PASS, FAIL) & ~blank(e["disclaimer_id"]) & ~blank(e["anchor"]))


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "one"))
    f = F.from_json("one", f"transcript_id string, title string, transcript string, expected_labels {schemas.EXPECTED}")
    rows = raw.select("pos", f.alias("f")).select("pos", F.col("f.transcript_id").alias("raw_id"), F.coalesce("f.title", F.lit("")).alias("title"), "f.transcript", valid_expected(F.col("f.expected_labels")).alias("expected_labels"))
    out = _identified(rows).select("transcript_id", "title", "transcript", F.lit("holdout").alias("dataset_role"), "expected_labels")
    if not out.agg(F.coalesce(F.sum(F.size("expected_labels")), F.lit(0))).first()[0]:
        raise ValueError(f"{path}: no expected labels")
    return out


def expected_rows(holdout: DataFrame) -> DataFrame:
    out = holdout.select("transcript_id", F.posexplode("expected_labels").alias("pos", "e"))
    return out.select("transcript_id", F.col("e.disclaimer_id").alias("rule_id"), F.coalesce("e.claim_type", F.lit("")).alias("claim_type"), F.col("e.anchor").alias("anchor"), F.col("e.label").alias("label"), "pos")


def read_json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; empty if the file is missing or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>"))).alias("one"))
    return raw.select(F.from_json("one", schema).alias("f")).filter("f is not null").select("f.*")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, labels of a report in CSV: the column COMPLIANT, else the last; of repeated ids the first row."""
    raw = spark.read.csv(path, header=True, encoding="utf-8")
    if "transcript_id" not in [c.lstrip("﻿") for c in raw.columns]:
        raise ValueError(f"{path}: no column transcript_id")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    column = "COMPLIANT" if "COMPLIANT" in raw.columns else raw.columns[-1]
    rows = raw.select(strip(F.col("transcript_id")).alias("transcript_id"), pass_labels(F.col(column)).alias("labels"), F.monotonically_increasing_id().alias("pos")).filter("transcript_id <> ''")
    first = F.row_number().over(Window.partitionBy("transcript_id").orderBy("pos"))
    return rows.withColumn("rn", first).filter("rn = 1").select("transcript_id", "labels")


def distinct_names(files: DataFrame) -> DataFrame:
    """files (name, pos) with unique: a repeated name gets _2, _3 and so on before its suffix."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    stem, suffix = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("n", n).withColumn("unique", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), suffix))).drop("n")
