"""Investigations of disagreements: what caused them, and samples that fill the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions.jsonx import llm_object_udf
from ..functions.text import collapse, strip
from .review import first_of

# The outcomes of an investigation, and other spellings of them.
CHANGED = ("missing_coverage", "covered_but_under_represented", "covered_but_boundary_confusing", "possible_label_noise")
CHANGED_ALIASES = {
    "thin_coverage": "covered_but_under_represented",
    "under_represented": "covered_but_under_represented",
    "underrepresented": "covered_but_under_represented",
    "covered_underrepresented": "covered_but_under_represented",
    "boundary_confusing": "covered_but_boundary_confusing",
    "label_noise": "possible_label_noise",
}
REGRESSED = ("missing_coverage", "under_represented_pattern", "boundary_regression", "possible_label_noise")
REGRESSED_ALIASES = {
    "thin_coverage": "under_represented_pattern",
    "under_represented": "under_represented_pattern",
    "underrepresented": "under_represented_pattern",
    "covered_but_under_represented": "under_represented_pattern",
    "covered_but_boundary_confusing": "boundary_regression",
    "post_retrain_boundary_regression": "boundary_regression",
    "boundary_confusing": "boundary_regression",
    "label_noise": "possible_label_noise",
}
# What is recommended for each outcome.
CHANGED_ADVICE = {
    "missing_coverage": "Generate targeted examples for this missing pattern; optionally add the exact reviewed phrase too.",
    "covered_but_under_represented": "Coverage exists but is too thin, so add targeted generated phrases to strengthen this pattern before retraining.",
    "possible_label_noise": "Inspect similar opposite-label synthetic examples before adding more data.",
    "covered_but_boundary_confusing": "Coverage exists, but the model still needs targeted boundary examples for this failed prediction before retraining.",
}
REGRESSED_ADVICE = {
    "missing_coverage": "Generate more same-label examples for this exact pattern before the next retrain.",
    "under_represented_pattern": "Keep the reviewed phrase in training and add a few nearby same-label variants before retraining again.",
    "possible_label_noise": "Inspect nearby opposite-label samples before another retrain because the dataset may be sending mixed signals.",
    "boundary_regression": "Retrain again with stronger emphasis on this phrase and inspect nearby boundary examples.",
}
# Samples by the topic of the anchor, the label, and what the phrase says.
TEMPLATES = {
    "identity fail records": (
        "After I unlock your account, I will verify your identity for our records.",
        "Once I unlock your account, I will verify your identity for our records.",
        "I will verify your identity for our records after I unlock your account.",
    ),
    "identity fail": (
        "I will unlock your account first, then verify your identity afterward for the ticket.",
        "Your account is already unlocked, and I will verify your identity afterward for our records.",
        "I can restore access right away, and then verify your identity after the account is open.",
    ),
    "identity pass": (
        "Before I unlock your account, I need to verify your identity first for security.",
        "Before I reset the account, I need to confirm your identity first.",
        "Identity verification has to be completed first before I restore access to your account.",
    ),
    "change fee pass priced": (
        "There will be a fee to make the change before I confirm the new flight for you.",
        "There is a fee to make this change, and I need to disclose that before I confirm the new itinerary.",
        "The new flight is a bit higher and there is a fee to make the change, so I need to go through that before confirmation.",
    ),
    "change fee pass": (
        "Before I confirm this booking change, a change fee will apply to the exchange.",
        "There will be a fee to make this booking change before I confirm the new itinerary.",
        "Before I confirm the new itinerary, you need to acknowledge that the airline change fee applies.",
    ),
    "change fee fail": (
        "There is no change fee for this booking change, so I can confirm it now.",
        "I have confirmed the change first, and any fee can be reviewed afterward.",
        "The booking is changed now; if a change fee appears, we can discuss it later.",
    ),
    "fare pass": (
        "There is a fare difference on the new itinerary, so you will pay the extra amount before I confirm it.",
        "The new flight costs more, so the fare difference will be charged before the booking change is confirmed.",
        "If the new itinerary is cheaper, the remaining balance will be issued as travel credit before confirmation.",
    ),
    "fare fail": (
        "We will decide later whether you pay the extra amount or receive travel credit.",
        "I can confirm the new itinerary now and work out any fare difference afterward.",
        "The new itinerary is confirmed, and we will decide later whether any fare balance or credit applies.",
    ),
}
ANSWER = "outcome string, rationale string, recommendation string, generated_samples array<string>"


def _spelt(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), "[- ]", "_")


def _named(answer: Column, known: tuple[str, ...], aliases: dict[str, str], fallback: Column) -> Column:
    a = _spelt(answer)
    for other, name in aliases.items():
        a = F.when(_spelt(answer) == other, F.lit(name)).otherwise(a)
    return F.when(a.isin(*known), a).otherwise(fallback)


def outcome(answer: Column, causes: Column) -> Column:
    """The outcome an answer names for a changed label, else what the causes (array) say: missing, thin, else a confusing boundary."""
    has = lambda x: F.array_contains(F.coalesce(causes, F.array().cast("array<string>")), x)
    fallback = F.when(has("missing_coverage"), "missing_coverage").when(has("thin_coverage"), "covered_but_under_represented").otherwise("covered_but_boundary_confusing")
    return _named(answer, CHANGED, CHANGED_ALIASES, fallback)


def regression_outcome(answer: Column, causes: Column) -> Column:
    """The same for a score that fell, in the order missing, thin, noise, boundary."""
    has = lambda x: F.array_contains(F.coalesce(causes, F.array().cast("array<string>")), x)
    fallback = F.when(has("missing_coverage"), "missing_coverage").when(has("thin_coverage"), "under_represented_pattern").when(has("possible_label_noise"), "possible_label_noise")
    return _named(answer, REGRESSED, REGRESSED_ALIASES, fallback.otherwise("boundary_regression"))


def advice(outcome: Column, given: dict[str, str]) -> Column:
    out = None
    for name, text in given.items():
        out = F.when(outcome == name, F.lit(text)) if out is None else out.when(outcome == name, F.lit(text))
    return out


def acceptable(anchor: Column, text: Column, label: Column) -> Column:
    """Not blank, and not a text whose key terms say the opposite of its label; other labels than the two are not held against it."""
    said = L.keyword_override(anchor, text)
    return (strip(F.coalesce(text, F.lit(""))) != "") & (~label.isin(L.PASS, L.FAIL) | said.isNull() | (said == label))


def template(anchor: Column, label: Column, phrase: Column) -> Column:
    """The key of the templates for a case, or null."""
    a, p = F.lower(F.coalesce(anchor, F.lit(""))), F.lower(strip(F.coalesce(phrase, F.lit(""))))
    has = lambda x, t: F.contains(x, F.lit(t))
    good = F.coalesce(label == L.PASS, F.lit(False))
    identity, fee, fare = has(a, "reset or unlock") | has(a, "verify your identity"), has(a, "change fee"), has(a, "fare difference") | has(a, "travel credit")
    records = has(p, "after i unlock your account") | has(p, "for our records") & has(p, "unlock")
    priced = has(p, "fee to make the change") | has(p, "new flight is a bit higher") & has(p, "fee")
    return (
        F.when(identity & ~good & records, "identity fail records").when(identity & ~good, "identity fail").when(identity, "identity pass")
        .when(fee & good & priced, "change fee pass priced").when(fee & good, "change fee pass").when(fee, "change fee fail")
        .when(fare & good, "fare pass").when(fare, "fare fail")
    )


def samples(items: DataFrame, answers: DataFrame, wanted: int = 3) -> DataFrame:
    """item_id, n, text, source: up to `wanted` samples for each item (item_id, anchor, label, phrase, outcome) that isn't label noise.

    Answers (item_id, pos, text) come first, then the first `wanted` templates of the case; both cleaned and
    checked. Texts are different from each other and from the phrase, whatever their case."""
    i = items.filter(F.col("outcome") != "possible_label_noise").withColumn("template", template(F.col("anchor"), F.col("label"), F.col("phrase")))
    other = collapse(F.col("phrase"), lower=True)
    given = i.join(answers, "item_id").select("item_id", "anchor", "label", "phrase", F.lit(0).alias("rank"), "pos", collapse(F.col("text")).alias("text"), F.lit("qwen").alias("source"))
    made = None
    for key, texts in TEMPLATES.items():
        listed = F.array(*[F.lit(t) for t in texts])
        made = F.when(F.col("template") == key, listed) if made is None else made.when(F.col("template") == key, listed)
    t = i.withColumn("other", other).withColumn("made", made).withColumn("made", F.slice(F.filter("made", lambda x: F.lower(x) != F.col("other")), 1, wanted))
    t = t.select("item_id", "anchor", "label", "phrase", F.lit(1).alias("rank"), F.posexplode("made").alias("pos", "text"), F.lit("fallback").alias("source"))
    every = given.unionByName(t).filter(acceptable(F.col("anchor"), F.col("text"), F.col("label"))).withColumn("key", F.lower("text")).filter(F.col("key") != other)
    once = first_of(every, [F.col("item_id"), F.col("key")], [F.col("rank"), F.col("pos")])
    listed = F.slice(F.array_sort(F.collect_list(F.struct("rank", "pos", "text", "source"))), 1, wanted)
    return once.groupBy("item_id").agg(listed.alias("s")).select("item_id", F.posexplode("s").alias("n", "x")).select("item_id", "n", "x.text", "x.source")


def investigate(analyses: DataFrame, answers: DataFrame, wanted: int = 3, retries: DataFrame | None = None) -> DataFrame:
    """item_id, outcome, rationale, causes, recommendation, samples, source of each analysis (item_id, anchor, label, phrase, causes, n_same, n_opposite).

    answers: item_id and a model's answer, JSON somewhere in its text; retries: the same of a second request, asked for
    more samples. Without an answer the causes decide. source: qwen, fallback, or mixed."""
    read = lambda df, name: df.select("item_id", F.from_json(llm_object_udf("answer"), ANSWER).alias(name))
    a = analyses.join(read(answers, "a"), "item_id", "left").withColumn("outcome", outcome(F.col("a.outcome"), F.col("causes")))
    given = a.select("item_id", F.posexplode("a.generated_samples").alias("pos", "text"))
    if retries is not None:
        given = given.unionByName(read(retries, "r").select("item_id", F.posexplode("r.generated_samples").alias("pos", "text")).withColumn("pos", F.col("pos") + 1_000_000))
    made = samples(a.select("item_id", "anchor", "label", "phrase", "outcome"), given, wanted)
    made = made.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("samples"), F.collect_set("source").alias("sources"))
    counted = F.format_string("Qwen outcome `%s` was used with deterministic coverage evidence: %d same-label sample(s), %d opposite-label sample(s).", "outcome", "n_same", "n_opposite")
    noise = F.array_contains("causes", "possible_label_noise") & (F.col("outcome") != "possible_label_noise")
    tags = F.when(noise, F.array("outcome", F.lit("possible_label_noise"))).otherwise(F.array("outcome"))
    source = F.when(F.size("sources") > 1, "mixed").otherwise(F.coalesce(F.get("sources", F.lit(0)), F.lit("")))
    return a.join(made, "item_id", "left").select(
        "item_id", "outcome", F.coalesce(F.nullif(strip(F.col("a.rationale")), F.lit("")), counted).alias("rationale"), tags.alias("causes"), advice(F.col("outcome"), CHANGED_ADVICE).alias("recommendation"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), source.alias("source"),
    )


def investigate_regressions(analyses: DataFrame, answers: DataFrame) -> DataFrame:
    """item_id, outcome, rationale, recommendation of each score that fell (item_id, causes)."""
    read = answers.select("item_id", F.from_json(llm_object_udf("answer"), ANSWER).alias("a"))
    a = analyses.join(read, "item_id", "left").withColumn("outcome", regression_outcome(F.col("a.outcome"), F.col("causes")))
    said = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    return a.select(
        "item_id", "outcome", F.coalesce(said("a.rationale"), F.lit("Agent review completed from the before/after movement and nearby dataset examples.")).alias("rationale"),
        F.coalesce(said("a.recommendation"), advice(F.col("outcome"), REGRESSED_ADVICE)).alias("recommendation"),
    )


def merge_diagnoses(changed: DataFrame, regressed: DataFrame) -> DataFrame:
    """All analyses of two reports, the first's first (part, 0 or 1); a column that one lacks is null there."""
    return changed.withColumn("part", F.lit(0)).unionByName(regressed.withColumn("part", F.lit(1)), allowMissingColumns=True)


def audit_inputs(pool: DataFrame, limit: int = 4, least: int = 2, seed: int = 11) -> DataFrame:
    """rule_id, anchor_key, n_pass, n_fail, positives, negatives, heuristic, prompt of each anchor of the pool (rule_id, anchor_key, label, dialogue, pos).

    A labeller sees at most `limit` examples of each class, drawn by hash, so that a hot anchor's examples are never gathered; the
    counts are of all. heuristic: gap if either class has fewer than `least`."""
    rows = pool.filter(F.col("label").isin(L.PASS, L.FAIL)).withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pos").cast("string")).cast("binary")))
    keys = ["rule_id", "anchor_key"]
    n = rows.groupBy(*keys).agg(F.count_if(F.col("label") == L.PASS).alias("n_pass"), F.count_if(F.col("label") == L.FAIL).alias("n_fail"))
    rank = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("h", "pos"))
    some = rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
    of = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("rank", "dialogue")))), lambda x: x["dialogue"])
    out = n.join(some.groupBy(*keys).agg(of(L.PASS).alias("positives"), of(L.FAIL).alias("negatives")), keys)
    heuristic = F.when((F.col("n_pass") < least) | (F.col("n_fail") < least), "gap").otherwise("covered")
    return out.withColumn("heuristic", heuristic).withColumn("prompt", F.to_json(F.struct("rule_id", F.col("anchor_key").alias("anchor"), "heuristic", F.col("positives").alias("compliant_examples"), F.col("negatives").alias("non_compliant_examples"))))


# What an audit says of a class without a labeller's note.
POOL_NOTES = {
    ("positive", True): "Positive pool size is acceptable.", ("positive", False): "Positive pool is still thin.",
    ("negative", True): "Negative pool size is acceptable.", ("negative", False): "Negative pool is still thin.",
}


def audited(inputs: DataFrame, answers: DataFrame, least: int = 2) -> DataFrame:
    """rule_id, anchor_key, n_pass, n_fail, coverage_status, positive_quality_note, negative_quality_note, source of each audited anchor.

    answers: key (rule_id:anchor_key) and a labeller's answer. An answer without one of the two statuses leaves the heuristic's; source tells whose it is."""
    a = audit_answers(answers).drop("reason", "generated_variants")
    known = F.coalesce(F.col("coverage_status").isin("covered", "gap"), F.lit(False))
    note = lambda kind, n: F.coalesce(F.nullif(F.col(f"{kind}_quality_note"), F.lit("")), F.when(F.col(n) >= least, POOL_NOTES[kind, True]).otherwise(POOL_NOTES[kind, False])).alias(f"{kind}_quality_note")
    out = inputs.withColumn("key", F.concat_ws(":", "rule_id", "anchor_key")).join(a, "key", "left")
    return out.select("rule_id", "anchor_key", "n_pass", "n_fail", F.when(known, F.col("coverage_status")).otherwise(F.col("heuristic")).alias("coverage_status"), note("positive", "n_pass"), note("negative", "n_fail"), F.when(known, "labeller").otherwise("heuristic").alias("source"))


def audit_answers(answers: DataFrame) -> DataFrame:
    """key, coverage_status, positive_quality_note, negative_quality_note, reason, generated_variants of a labeller's answers (key, answer) on the quality of examples."""
    fields = ("coverage_status", "positive_quality_note", "negative_quality_note", "reason")
    schema = ", ".join(f"{f} string" for f in fields) + ", generated_variants array<string>"
    a = answers.select("key", F.from_json(llm_object_udf("answer"), schema).alias("a"))
    text = lambda f: strip(F.coalesce(F.col(f"a.{f}"), F.lit("")))
    variants = F.filter(F.transform(F.coalesce("a.generated_variants", F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return a.select("key", F.lower(text("coverage_status")).alias("coverage_status"), *[text(f).alias(f) for f in fields[1:]], variants.alias("generated_variants"))
