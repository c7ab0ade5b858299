"""Transcripts to turns, sides and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_speaker, strip, words

#: The patterns of header lines. Diarised: speaker number, start, end, text. Named: name, text.
DIARISED = r"^SPEAKER_(\d+)[ \t]+\[([\d.]+)s[ \t]*-[ \t]*([\d.]+)s\]:[ \t]*(.*)$"
NAMED = r"^([A-Za-z][A-Za-z0-9 _/\-]{0,40})[ \t]*:[ \t]*(.*)$"


def lines(transcripts: DataFrame) -> DataFrame:
    """transcript_id, line_pos, line: stripped, without blank lines."""
    split = F.split(F.coalesce("transcript", F.lit("")), r"\r\n|[\n\r\x0B\f]", -1)
    out = transcripts.select("transcript_id", F.posexplode(split).alias("line_pos", "line"))
    return out.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def turns(transcripts: DataFrame) -> DataFrame:
    """transcript_id, turn, speaker, side, text: a turn starts at a header line and has the lines after it.

    Lines before the first header belong to no turn; lines after a header without text are lost."""
    marked = lines(transcripts).select(
        "transcript_id", "line_pos", "line", F.regexp_extract("line", DIARISED, 1).alias("number"), F.regexp_extract("line", NAMED, 1).alias("name")
    )
    diarised, named = F.col("number") != "", F.col("name") != ""
    speaker = F.when(diarised, F.concat(F.lit("speaker_"), F.col("number"))).when(named, normal_speaker(F.col("name")))
    first = F.when(diarised, F.regexp_extract("line", DIARISED, 4)).when(named, F.regexp_extract("line", NAMED, 2))
    order = Window.partitionBy("transcript_id").orderBy("line_pos")
    marked = marked.withColumn("header", (diarised | named).cast("int")).withColumn("speaker", speaker).withColumn("part", F.when(F.col("header") == 1, strip(first)).otherwise(F.col("line")))
    marked = marked.withColumn("turn", F.sum("header").over(order)).filter("turn > 0")
    grouped = marked.groupBy("transcript_id", "turn").agg(
        F.max("speaker").alias("speaker"),
        F.max(F.when(F.col("header") == 1, F.col("part"))).alias("opening"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "part"))), lambda x: x["part"]), " ").alias("text"),
    )
    number = F.regexp_extract("speaker", r"^speaker_(\d+)$", 1)
    side = F.when(number != "", F.when(number.cast("bigint") % 2 == 0, F.lit("sca")).otherwise(F.lit("client")))
    return grouped.filter("opening <> ''").select("transcript_id", F.col("turn").cast("int").alias("turn"), "speaker", side.alias("side"), "text")


def speaker_text(transcripts: DataFrame, speakers: Sequence[str], keep_unlabelled: bool = False) -> DataFrame:
    """transcript_id, text: what the named speakers said, in order; empty if they said nothing.

    Without names it is the whole text. keep_unlabelled: transcripts without any header count as theirs."""
    if not [s for s in speakers if s.strip()]:
        return transcripts.select("transcript_id", strip(F.coalesce("transcript", F.lit(""))).alias("text"))
    wanted = F.col("speaker").isin(*[" ".join(s.strip().rstrip(":").lower().split()) for s in speakers])
    said = turns(transcripts).groupBy("transcript_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("turn", "text")))), lambda x: x["text"]), " ").alias("said"), F.lit(1).alias("labelled")
    )
    out = transcripts.join(said, "transcript_id", "left")
    whole = F.when(F.col("labelled").isNull(), strip(F.coalesce("transcript", F.lit("")))) if keep_unlabelled else F.lit(None)
    return out.select("transcript_id", F.coalesce("said", whole, F.lit("")).alias("text"))


def structured_sides(transcripts: DataFrame) -> DataFrame:
    """transcript_id, sca, client: turns of diarised lines by parity of the speaker's number; turns of one side in a row are one.

    Only diarised headers count; other lines continue the turn before."""
    marked = lines(transcripts).withColumn("number", F.regexp_extract("line", DIARISED, 1))
    order = Window.partitionBy("transcript_id").orderBy("line_pos")
    marked = marked.withColumn("head", (F.col("number") != "").cast("int")).withColumn("seen", F.sum("head").over(order)).filter("seen > 0")
    marked = marked.withColumn("part", F.when(F.col("head") == 1, strip(F.regexp_extract("line", DIARISED, 4))).otherwise(F.col("line")))
    marked = marked.withColumn("side", F.last(F.when(F.col("head") == 1, F.col("number").cast("bigint") % 2), ignorenulls=True).over(order))
    change = (F.col("side") != F.coalesce(F.lag("side").over(order), F.lit(-1))).cast("int")
    marked = marked.withColumn("change", change).withColumn("island", F.sum("change").over(order))
    joined = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "part"))), lambda x: x["part"]), " "))
    islands = marked.groupBy("transcript_id", "island").agg(F.first("side").alias("side"), joined.alias("text"))
    of = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("island", "text")))), lambda x: x["text"])
    return islands.groupBy("transcript_id").agg(of(0).alias("sca"), of(1).alias("client"))


def plain_text(transcripts: DataFrame) -> DataFrame:
    """transcript_id, transcript: diarised headers cut off, blank lines gone."""
    out = lines(transcripts).withColumn("line", F.when(F.col("line").rlike(DIARISED), strip(F.regexp_extract("line", DIARISED, 4))).otherwise(F.col("line"))).filter("line <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"]), "\n")
    return out.groupBy("transcript_id").agg(text.alias("transcript"))


def chunk_array(text: Column, w: Column, size: int, overlap: int) -> Column:
    """Windows of `size` words that overlap. A text of at most `size` words is one chunk, as it is;
    a last chunk of one word is left out unless it is the first.

    w: the text's words, a column of its own: what a lambda captures is evaluated again for each element."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: (i == 0) | (F.size(w) - i >= 2))
    long = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    return F.when(F.size(w) > size, long).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def chunks(texts: DataFrame, size: int = 20, overlap: int = 15) -> DataFrame:
    """texts (id, text) exploded: chunk_id, chunk."""
    rest = [c for c in texts.columns if c != "text"]
    held = "talkledger words of the text"
    split = texts.withColumn(held, words(F.col("text")))
    return split.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(chunk_array(F.col("text"), F.col(f"`{held}`"), size, overlap)).alias("chunk_id", "chunk"))
