"""Tables as front ends send them, in one column of JSON payloads, to one schema.

A payload is a list of objects, a list of lists (whose headers follow from how many columns there are), or an object with data
and headers. Which it is, is told for every payload by its own VARIANT.

Defined cases: null, broken and empty payloads, and payloads of another shape, have no rows; in a list of lists,
rows that are no lists are skipped, and so they are beside headers; a row that is longer than its headers loses what is beyond,
a shorter one lacks the rest; of repeated headers the last holds; cells that are no scalars are their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import checked, score_or, strip

# Headers of tables without any, by their number of columns: eight, more, fewer.
EIGHT = ("add", "rule", "score", "anchor", "text", "model", "qwen", "human")
MORE = ("add", "transcript", "rule", "score", "text", "model_label", "qwen_label", "final_label")
FEWER = ("add", "rule", "score", "text", "model_label", "qwen_label", "final_label")


def _kind(v: Column) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit(""))


def records(payloads: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """key, row_n (from 0), cells (a map by header) of every row of the payloads."""
    v = payloads.select(key, F.try_parse_json(payload).alias("v")).filter("v is not null")
    inside = lambda path: F.when(_kind(F.try_variant_get("v", path, "variant")) == "ARRAY", F.try_variant_get("v", path, "array<variant>"))
    bare = _kind(F.col("v")) == "ARRAY"
    named = lambda path: F.when(F.size(inside(path)) > 0, inside(path))
    headers = F.when(~bare, F.coalesce(named("$.headers"), named("$.columns"), inside("$.columns"), inside("$.headers")))
    v = v.select(key, F.when(bare, F.try_variant_get("v", "$", "array<variant>")).otherwise(inside("$.data")).alias("list"), headers.alias("headers"))
    of_header = lambda h: strip(F.when(_kind(h) == "OBJECT", F.coalesce(F.try_variant_get(h, "$.name", "string"), F.try_variant_get(h, "$.id", "string"), F.lit(""))).otherwise(F.coalesce(F.try_variant_get(h, "$", "string"), F.lit(""))))
    v = v.withColumns({"names": F.transform("headers", of_header), "objects": F.col("headers").isNull() & F.forall("list", lambda e: _kind(e) == "OBJECT")})
    v = v.withColumn("rows", F.when(F.col("objects"), F.col("list")).otherwise(F.filter("list", lambda e: _kind(e) == "ARRAY")))
    rows = v.select(key, "names", "objects", F.posexplode("rows").alias("row_n", "e"))
    values = F.try_variant_get("e", "$", "array<string>")
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    rows = rows.withColumn("values", F.when(~F.col("objects"), values))
    n = F.size("values")
    rows = rows.withColumn("names", F.coalesce("names", F.when(n == len(EIGHT), listed(EIGHT)).when(n > len(EIGHT), listed(MORE)).otherwise(listed(FEWER))))
    pairs = F.arrays_zip(F.slice("names", 1, F.least(F.size("names"), n)).alias("k"), F.slice("values", 1, F.least(F.size("names"), n)).alias("x"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    cells = F.when(F.col("objects"), F.try_variant_get("e", "$", "map<string,string>")).otherwise(F.map_from_entries(last))
    return rows.select(key, "row_n", cells.alias("cells"))


def review_rows(found: DataFrame, key: str = "id") -> DataFrame:
    """key, row_n, approved, rule_id, score, text, model_label, reviewer_label, final_label of records; a final label that is blank is the model's, else the reviewer's."""
    of = lambda *names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])
    some = lambda x: F.nullif(x, F.lit(""))
    model, reviewer, final = of("model", "model_label", "verifier_label"), of("qwen", "qwen_label"), of("human", "final_label", "final")
    label = lambda x: L.normalise(x, "training")
    return found.select(
        key, "row_n", checked(of("add", "add_to_training")).alias("approved"), strip(F.coalesce(some(of("rule")), some(of("rule_id")), F.lit(""))).alias("rule_id"),
        score_or(of("score", "verification_score")).alias("score"), F.coalesce(of("text"), F.lit("")).alias("text"),
        label(model).alias("model_label"), label(reviewer).alias("reviewer_label"), label(F.coalesce(some(final), some(model), some(reviewer))).alias("final_label"),
    )
