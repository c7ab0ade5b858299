"""A log of review edits, and what follows from it: the queue as it stands, and its counts.

Reviewers append edits (item_id, at, label, approved, text; null: not edited). Folding the log keeps, for each item and field,
the last edit; `at` orders them, and equal times go to the larger label, then text, so that all readers agree. A folded log
is a log again: compaction replaces many edits by one for each item, and later edits fold the same way.

Defined cases: edits of items that the queue lacks are ignored; an edit without any field changes nothing; null items
are ignored; repeated edits count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.versions import Store

FIELDS = ("label", "approved", "text")
EDIT = "item_id string, at long, label string, approved boolean, text string"


def fold(log: DataFrame) -> DataFrame:
    """One edit for each item (item_id, at, label, approved, text), with the last value of each field: one aggregate, combined before the shuffle."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("approved", F.lit(False))))).alias(c)
    return log.filter("item_id is not null").groupBy("item_id").agg(F.max("at").alias("at"), *[last(c) for c in FIELDS])


def apply(queue: DataFrame, log: DataFrame) -> DataFrame:
    """The queue (item_id, final_label, approved, text, ...) after all edits; `edited` tells which rows have any."""
    e = fold(log).select(F.col("item_id"), *[F.col(c).alias(f"e_{c}") for c in FIELDS])
    label = L.normalise(F.col("e_label"), "review")
    skip = F.lower(F.trim("e_label")) == "skip"
    out = queue.join(e, "item_id", "left")
    final = F.when(F.col("e_label").isNull(), F.col("final_label")).when(skip, F.lit("")).otherwise(F.coalesce(F.nullif(label, F.lit("")), F.col("final_label")))
    changed = F.coalesce(F.greatest(*[F.col(f"e_{c}").isNotNull() for c in FIELDS]), F.lit(False))
    out = out.withColumns({"final_label": final, "approved": F.coalesce("e_approved", "approved") & ~F.coalesce(skip, F.lit(False)), "text": F.coalesce("e_text", "text"), "edited": changed})
    return out.select(*queue.columns, "edited")


def counts(queue: DataFrame) -> DataFrame:
    """rows, selected (approved), trainable (approved with a usable label and a text), by label."""
    usable = F.coalesce("approved", F.lit(False)) & F.col("final_label").isin(L.PASS, L.FAIL) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return queue.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce("approved", F.lit(False))).alias("selected"), F.count_if(usable).alias("trainable"),
        F.count_if(usable & (F.col("final_label") == L.PASS)).alias("trainable_pass"), F.count_if(usable & (F.col("final_label") == L.FAIL)).alias("trainable_fail"),
    )


def append(store: Store, edits: DataFrame) -> int:
    """Add edits to the log. Each append is a table of its own, so two reviewers never overwrite each other."""
    path = store.stage(edits.select("item_id", "at", *FIELDS), "edits")
    return store.update(lambda state: ({f"edits/{state['number'] + 1:010d}": path}, {}))


def read(store: Store) -> DataFrame:
    state = store.state()
    paths = [p for n, p in sorted(state["tables"].items()) if n.startswith("edits/")]
    return store.spark.read.schema(EDIT).parquet(*paths) if paths else store.spark.createDataFrame([], EDIT)


def compact(store: Store) -> int:
    """Replace the log by its fold, in one commit; edits that were appended meanwhile stay beside it."""
    state = store.state()
    names = [n for n in state["tables"] if n.startswith("edits/")]
    if len(names) < 2:
        return state["number"]
    path = store.stage(fold(store.spark.read.schema(EDIT).parquet(*[state["tables"][n] for n in names])), "edits")
    return store.update(lambda _: ({n: None for n in names} | {min(names): path}, {}))
