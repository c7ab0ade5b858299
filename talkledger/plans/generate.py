"""Resumable generation: prompts go to a model, what it makes is filtered and judged, and what fails is asked again with the reason.

Every round is two tables: the rows of accepted answers, and then the attempts, one for each prompt asked, with its score, whether
it was accepted, and the hint for the next round. A round counts once its attempts are whole; until then its tables are written
over, so a job that is repeated adds nothing twice, and one that was lost goes on with the round it was in. The state of a prompt
follows from the attempts, wherever they were made.

Defined cases: an answer without an array keeps nothing; a judge's answer without an object is a score of 0; without a judge, enough
usable snippets are accepted with a score of 10; prompts that are equal in rule, scenario and number are one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import snippets
from ..sources.readers import exists

#: Takes (system instruction, prompt, hint, round) and returns an answer's text.
Client = Callable[[str, str, str, int], str]
#: Takes (system instruction, prompt, answer) and returns a judgement's text: an object with pass, score and notes.
Judge = Callable[[str, str, str], str]
KEY = ["rule_id", "scenario", "prompt_index"]
_ANSWER = "rule_id string, scenario string, prompt_index int, answer_id string, answer string, judgement string"
_ATTEMPT = "rule_id string, scenario string, prompt_index int, accepted boolean, score int, kept int, hint string, round int"
_ROW = "rule_id string, scenario string, prompt_index int, type string, dialogue string, source_batch_size int, kept_after_filter int, supervisor_score int, round int"
# What a model is told after a failed attempt, by the first check that failed.
HINTS = {
    "array": "Output must be ONLY a valid JSON array (no extra text).",
    "schema": "Fix schema: each item must have exactly keys {label, text} and both must be strings.",
    "too_short": "Make snippets longer: each agent turn must be at least %d words.",
    "multi_speaker": "Ensure each item is agent-only with no role prefixes or multi-speaker text.",
    "other": "Follow the prompt constraints more clearly; ensure compliant vs near-miss patterns are obvious.",
    "notes": " Supervisor notes: ",
}


def ask(prompts: DataFrame, client: Client, number: int, judge: Judge | None = None) -> DataFrame:
    """The array in the answer to each prompt, as JSON text or null, and the judgement of the answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.jsonx import balanced

        for b in batches:
            rows = b.to_pylist()
            said = [client(r["system_instruction"] or "", r["user_prompt"], r["hint"] or "", number) for r in rows]
            judged = [None if judge is None else balanced(judge(r["system_instruction"] or "", r["user_prompt"], a), "{") or "{}" for r, a in zip(rows, said, strict=True)]
            ids = [f"{r['rule_id']}/{r['scenario']}/{r['prompt_index']}" for r in rows]
            texts = [pa.array(x, pa.string()) for x in (ids, [balanced(a, "[") for a in said], judged)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), *texts], names=[*KEY, "answer_id", "answer", "judgement"])

    return prompts.select(*KEY, "system_instruction", "user_prompt", "hint").mapInArrow(run, _ANSWER)


def hint(is_array: Column, schema: Column, too_short: Column, multi_speaker: Column, notes: Column, min_words: int) -> Column:
    """What to tell the model next, from the counts of what its answer's checks dropped and the judge's notes."""
    first = F.when(~is_array, HINTS["array"]).when(schema > 0, HINTS["schema"]).when(too_short > 0, HINTS["too_short"] % min_words).when(multi_speaker > 0, HINTS["multi_speaker"]).otherwise(HINTS["other"])
    said = strip(F.coalesce(notes, F.lit("")))
    return F.when(said != "", F.concat(first, F.lit(HINTS["notes"]), said)).otherwise(first)


def assessed(answers: DataFrame, least_kept: int, min_words: int, max_words: int = 60) -> tuple[DataFrame, DataFrame]:
    """Attempts (accepted, score, kept, hint) and their usable snippets, of answers (the key, answer_id, answer, judgement)."""
    judged = snippets.judged_snippets(answers.filter("answer is not null").select("answer_id", "answer"), min_words, max_words)
    stats = snippets.snippet_stats(judged)
    a = answers.join(stats, "answer_id", "left").na.fill(0, ["input_len", "kept", "dropped_schema", "dropped_too_short", "dropped_multi_speaker"])
    v = F.try_parse_json("judgement")
    score = F.when(F.col("judgement").isNull(), 10).otherwise(F.coalesce(F.try_variant_get(v, "$.score", "int"), F.lit(0)))
    passed = F.col("judgement").isNull() | snippets.judge_accepts(F.col("judgement"))
    told = hint(F.col("answer").isNotNull(), F.col("dropped_schema"), F.col("dropped_too_short"), F.col("dropped_multi_speaker"), F.try_variant_get(v, "$.notes", "string"), min_words)
    accepted = passed & (F.col("kept") >= least_kept)
    attempts = a.select(*KEY, "answer_id", accepted.alias("accepted"), score.alias("score"), F.col("kept").cast("int").alias("kept"), F.col("input_len").cast("int").alias("input_len"), F.when(~accepted, told).alias("hint"))
    kept = judged.filter(F.col("reason").isin("kept", "kept_long"))
    return attempts, kept


def generate(prompts: DataFrame, client: Client, output: str, least_kept: int = 10, rounds: int = 3, min_words: int = 5, judge: Judge | None = None) -> dict[str, int]:
    """Fill output/rows with accepted snippets, round by round; how many prompts were done and are left."""
    spark = prompts.sparkSession
    prompts = prompts.dropDuplicates(KEY)
    attempts = lambda: spark.read.schema(_ATTEMPT).parquet(*[f"{output}/attempts-{n}" for n in range(rounds) if exists(spark, f"{output}/attempts-{n}/_SUCCESS")]) if exists(spark, f"{output}/attempts-0/_SUCCESS") else spark.createDataFrame([], _ATTEMPT)
    for number in range(rounds):
        if exists(spark, f"{output}/attempts-{number}/_SUCCESS"):
            continue
        before = attempts()
        open_ = prompts.join(before.filter("accepted").select(*KEY), KEY, "left_anti")
        last = before.groupBy(*KEY).agg(F.max_by("hint", "round").alias("hint"))
        open_ = open_.join(last, KEY, "left")
        # Asked once: the answers are a table before anything is computed from them.
        ask(open_, client, number, judge).write.mode("overwrite").parquet(f"{output}/answers-{number}")

        def stored(df: DataFrame, name: str, number: int = number) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{output}/{name}-{number}")
            return spark.read.schema(df.schema).parquet(f"{output}/{name}-{number}")

        tried, kept = assessed(spark.read.schema(_ANSWER).parquet(f"{output}/answers-{number}"), least_kept, min_words)
        # Both are used more than once, or cost much beside what a join keeps of them: tables, too.
        tried, kept = stored(tried, "tried"), stored(kept, "judged")
        rows = kept.join(tried.filter("accepted"), "answer_id")
        rows = rows.select(*KEY, F.when(F.col("label") == "Compliant", "compliant").otherwise("non-compliant").alias("type"), strip(F.lower("text")).alias("dialogue"), F.col("input_len").alias("source_batch_size"), F.col("kept").alias("kept_after_filter"), F.col("score").alias("supervisor_score"))
        rows.write.mode("overwrite").parquet(f"{output}/rows/round={number}")
        tried.select(*KEY, "accepted", "score", "kept", "hint", F.lit(number).alias("round")).write.mode("overwrite").parquet(f"{output}/attempts-{number}")
    done = attempts().filter("accepted").select(*KEY).distinct().join(prompts.select(*KEY), KEY, "left_semi").count()
    return {"done": done, "left": prompts.count() - done}


def rows_of(spark, output: str) -> DataFrame:  # noqa: ANN001
    """The accepted snippets, as training rows."""
    return spark.read.schema(_ROW).option("basePath", f"{output}/rows").parquet(f"{output}/rows")
