"""What people read and edit: lines, tables, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import checked, collapse, compact, leaks_reasoning, score_or, strip, strip_think, strip_think_open


def rule_lines(rule_rows: DataFrame) -> DataFrame:
    """transcript_id, report: a line for each rule, in order."""
    line = F.format_string("Rule %s: %s (score %.3f)", "rule_id", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("score"))
    return rule_rows.groupBy("transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))


def suggestion(rule: Column, final: Column, reviewer: Column, score: Column, text: Column) -> Column:
    """The line that suggests a final label: the final, else the reviewer's, else the score's."""
    own, given = L.normalise(final, "display"), L.normalise(reviewer, "display")
    label = F.coalesce(F.nullif(own, F.lit("")), F.nullif(given, F.lit("")), F.when(score >= 0.5, "Pass").otherwise("Fail"))
    phrase = F.coalesce(F.nullif(compact(text, 180), F.lit("")), F.lit("No phrase available."))
    note = F.when(given != "", F.concat(F.lit(" Reviewer: "), given, F.lit("."))).otherwise("")
    return F.concat(F.format_string("Rule %s: %s, score %.3f. Phrase: \"", F.coalesce(F.nullif(strip(rule), F.lit("")), F.lit("unknown")), label, score), phrase, F.lit('".'), note)


def numbered_lines(rows: DataFrame, group: str, order: str, line: Column) -> DataFrame:
    every = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    numbered = F.transform(every, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    return rows.groupBy(group).agg(F.array_join(numbered, "\n").alias("lines"))


def merge_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """items (pos, ...) with edits (pos, label, approved) of a table, by position; items without an edit stay as they are."""
    e = edits.select("pos", L.normalise(F.col("label"), "training").alias("e_label"), checked(F.col("approved")).alias("e_approved"), F.lit(True).alias("edited"))
    out = items.join(e, "pos", "left")
    return out.withColumn("final_label", F.when(F.col("edited"), F.col("e_label")).otherwise(F.col("final_label"))).withColumn("approved", F.when(F.col("edited"), F.col("e_approved")).otherwise(F.col("approved"))).drop("e_label", "e_approved", "edited")


def select_all(label: Column) -> Column:
    return L.normalise(label, "display").isin("Pass", "Fail")


def rule_cell(score: Column, claim_scores: Column) -> Column:
    """The rule's score, else the least of its claims'."""
    return F.coalesce(score.try_cast("double"), F.array_min(F.transform(claim_scores, lambda x: score_or(x))))


def compare_status(after: Column, human: Column, delta: Column) -> Column:
    """What a reviewer sees of a comparison, and the arrow of the change."""
    agrees = L.from_score(after) == L.normalise(human, "review")
    arrow = F.when(delta > 0.0005, "up").when(delta < -0.0005, "down").otherwise("flat")
    return F.concat(F.when(agrees, F.lit("success")).otherwise(F.lit("open")), F.lit(":"), arrow)


def chat_history(history: DataFrame, last: int = 6, limit: int = 500) -> DataFrame:
    """chat_id, pos, role, content: the last messages of users and assistants, without hidden thoughts, cut."""
    rows = history.select("chat_id", "pos", F.lower(strip(F.coalesce("role", F.lit("")))).alias("role"), strip_think_open(F.col("content")).alias("content"))
    rows = rows.filter(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    kept = F.array_sort(F.collect_list(F.struct("pos", "role", compact(F.col("content"), limit).alias("content"))))
    return rows.groupBy("chat_id").agg(kept.alias("m")).select("chat_id", F.explode(F.slice("m", F.greatest(F.lit(1), F.size("m") - last + 1), last)).alias("x")).select("chat_id", "x.*")


#: What rules and claims are called on screen.
RULE_NAMES = {"101": "Identity verification", "102": "Change of Booking"}
CLAIM_NAMES = {("102", "mandatory", 0): "Disclosure 1: Change fee", ("102", "mandatory", 1): "Disclosure 2: Fare difference or travel credit"}
#: Answers that need no model, and what they answer.
GREETINGS = ("hi", "hello", "hey", "yo")
GREETING = "Hi. I can help explain the current inference result, borderline phrases, or Qwen labels."
NO_ITEMS = "There are no borderline phrases in the current review queue."
NO_RESULT = "No inference result is available yet."
NO_ANSWER = "I can help explain the current inference result or review labels."


def rule_name(rule: Column, description: Column, names: dict[str, str] | None = None) -> Column:
    """A rule's display name, else its description."""
    r, out = strip(rule), F.lit(None).cast("string")
    for k, v in (RULE_NAMES if names is None else names).items():
        out = F.when(r == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, strip(F.coalesce(description, F.lit(""))))


def claim_name(rule: Column, kind: Column, order: Column, names: dict[tuple[str, str, int], str] | None = None) -> Column:
    """A claim's display name by rule, type and place, else null."""
    out = F.lit(None).cast("string")
    for (r, k, n), v in (CLAIM_NAMES if names is None else names).items():
        out = F.when((strip(rule) == r) & (kind == k) & (order == n), F.lit(v)).otherwise(out)
    return out


def results_only(payload: Column) -> Column:
    """The results within a payload in JSON, else the payload itself."""
    inner = F.get_json_object(payload, "$.results")
    return F.when(F.startswith(inner, F.lit("{")), inner).otherwise(payload)


def short_summary(rule_rows: DataFrame) -> DataFrame:
    """transcript_id, summary: each rule's status and score, in order."""
    line = F.format_string("Rule %s: %s, score %.3f", "rule_id", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("score"))
    every = F.array_sort(F.collect_list(F.struct("rule_pos", line.alias("line"))))
    return rule_rows.groupBy("transcript_id").agg(F.concat(F.array_join(F.transform(every, lambda x: x["line"]), "\n"), F.lit(".")).alias("summary"))


def inference_summary(rule_rows: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """transcript_id, summary: the same with how many claims passed."""
    counts = claim_rows.groupBy("transcript_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))
    one = F.when(F.col("n_passed") > 0, " - required evidence was found").otherwise(" - required evidence was not found")
    detail = F.when(F.col("n") == 1, one).when(F.col("n") > 1, F.format_string(" - %d/%d required disclosures passed", "n_passed", "n")).otherwise("")
    line = F.concat(F.format_string("Rule %s: %s, score %.3f", "rule_id", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("score")), detail, F.lit("."))
    every = rule_rows.join(counts, ["transcript_id", "rule_id"], "left").withColumn("line", line)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rule_pos", "line"))), lambda x: x["line"])
    return every.groupBy("transcript_id").agg(F.concat(F.lit("Current inference summary:\n"), F.array_join(listed, "\n")).alias("summary"))


def item_lines(index: Column, rule: Column, anchor: Column, text: Column, score: Column, reviewer: Column) -> Column:
    """A review item as lines of text."""
    or_else = lambda x, no: F.coalesce(F.nullif(compact(x, 220), F.lit("")), F.lit(no))
    head = F.format_string("Review item %d: Rule %s", index, strip(F.coalesce(rule, F.lit(""))))
    parts = [head, F.concat(F.lit("  Anchor: "), or_else(anchor, "No anchor available.")), F.concat(F.lit("  Best text: "), or_else(text, "No matched text available."))]
    parts += [F.format_string("  Score: %.3f", F.coalesce(score, F.lit(0.0))), F.concat(F.lit("  Model label: "), L.from_score(F.coalesce(score, F.lit(0.0))))]
    given = strip(F.coalesce(reviewer, F.lit("")))
    return F.concat_ws("\n", *parts, F.when(given != "", F.concat(F.lit("  Qwen label: "), given)))


def explanation(rule: Column, score: Column, reviewer: Column, anchor: Column, text: Column) -> Column:
    """What a borderline item is about, as the lines of a numbered list."""
    or_else = lambda x, no: F.coalesce(F.nullif(x, F.lit("")), F.lit(no))
    first = F.format_string("Rule %s, score %.3f, Qwen label: %s.", or_else(strip(rule), "unknown"), F.coalesce(score, F.lit(0.0)), or_else(L.normalise(reviewer, "display"), "not labeled yet"))
    return F.concat(first, F.lit("\n   Anchor: "), or_else(compact(anchor, 180), "No anchor available."), F.lit("\n   Phrase: "), or_else(compact(text, 180), "No phrase available."))


def chat_context(rule_rows: DataFrame, claim_rows: DataFrame, descriptions: DataFrame, limit: int = 240) -> DataFrame:
    """transcript_id, context: rules and claims in short, as JSON for a model. Texts are cut to `limit` characters."""
    claim = F.struct("claim_type", F.col("claim_ord").alias("claim_index"), "passed", F.round("ver", 4).alias("score"), compact(F.col("anchor"), limit).alias("anchor"), compact(F.col("text"), limit).alias("best_text"))
    listed = claim_rows.groupBy("transcript_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", claim.alias("c")))), lambda x: x["c"]).alias("claims"))
    about = descriptions.select("rule_id", compact(F.col("description"), 160).alias("description"))
    rows = rule_rows.join(F.broadcast(about), "rule_id", "left").join(listed, ["transcript_id", "rule_id"], "left")
    best = F.when(F.col("claims").isNull(), compact(F.col("evidence"), limit))
    rule = F.struct("rule_id", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), F.round("score", 4).alias("score"), F.nullif("description", F.lit("")).alias("description"), "claims", best.alias("best_text"))
    every = rows.groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_pos", rule.alias("r")))), lambda x: x["r"]).alias("rules"))
    return every.select("transcript_id", F.to_json(F.struct("rules")).alias("context"))


def chat_answer(question: Column, n_items: Column, summary: Column, suggested: Column, explained: Column, answer: Column) -> Column:
    """The answer to a question: a greeting, what the review queue says, else the model's without hidden
    thoughts; if that leaks its reasoning, the queue's answer or the summary."""
    q = strip(F.coalesce(question, F.lit("")))
    low = F.lower(q)
    n = collapse(F.regexp_replace(low, r"[.?!]+\z", ""))
    has = lambda t: F.contains(n, F.lit(t))
    about = has("borderline")
    direct = F.when(about & has("final label") & has("suggest"), suggested).when(about & (has("explain") | has("phrase")), explained)
    said = strip_think(answer)
    modelled = F.when(leaks_reasoning(said), F.coalesce(summary, F.lit(NO_RESULT))).otherwise(F.coalesce(F.nullif(said, F.lit("")), F.lit(NO_ANSWER)))
    none = F.concat(F.lit(NO_ITEMS + "\n"), F.coalesce(summary, F.lit(NO_RESULT)))
    return F.when(low.isin(*GREETINGS), GREETING).when(F.contains(low, F.lit("borderline")) & (F.coalesce(n_items, F.lit(0)) == 0), none).otherwise(F.coalesce(direct, modelled))
