"""An extension: transcripts that arrive as files. Each micro-batch goes through the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules, scoring, segment


def stream_reports(spark: SparkSession, folder: str, rule_table: DataFrame, speakers: list[str], output: str, checkpoint: str, settings: scoring.Settings = scoring.Settings()) -> StreamingQuery:  # noqa: B008
    """Rule results of each new *.txt in folder, appended to output. A batch that runs again replaces its own folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    arriving = raw.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("transcript_id"), F.col("value").alias("transcript"))
    claims = rules.claims(rule_table)

    def report(batch: DataFrame, number: int) -> None:
        said = segment.speaker_text(batch, speakers)
        hits = scoring.hits(segment.chunks(said, settings.chunk_words, settings.overlap), claims, settings)
        rows = scoring.rule_results(said, rule_table, scoring.claim_results(said, claims, hits, settings))
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arriving.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
