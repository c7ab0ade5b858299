"""python -m talkledger.cli report|loop|train|split: the operators from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import config
from .operators import fitting, rules, scoring, segment, training
from .plans import loop
from .session import local_session
from .sources import readers, sinks
from .sources.versions import Store, promote


def _said(spark, path: str, speakers: list[str]):  # noqa: ANN001, ANN202
    return segment.speaker_text(readers.read_incoming(spark, path), speakers)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="talkledger")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("report", "loop"):
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--input", required=True)
        s.add_argument("--rules", required=True)
        s.add_argument("--output", required=True)
        s.add_argument("--require-human-review", action="store_true")
        s.add_argument("--dataset", help="training rows as JSON lines")
        s.add_argument("--run", default="1", help="id of a run; one that was lost goes on")
    s = sub.add_parser("split")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--train-size", type=int, required=True)
    s.add_argument("--seed", type=int, default=42)
    s = sub.add_parser("train")
    s.add_argument("--model", choices=("verifier", "retriever"), required=True)
    s.add_argument("--input", required=True, help="training rows as JSON lines: disclaimer_id, anchor, dialogue, type, sample_weight")
    s.add_argument("--output", required=True, help="folder of the versions")
    a = p.parse_args(argv)
    spark = local_session()
    if a.command == "train":
        pairs = loop.training_pairs(spark.read.schema("disclaimer_id string, anchor string, dialogue string, type string, sample_weight int").json(a.input))
        store = Store(spark, a.output)
        if a.model == "verifier":
            model = fitting.fit_verifier(pairs)
        else:
            rows = pairs.select("row_id", F.concat_ws("|", "disclaimer_id", F.lower("anchor")).alias("grp"), "anchor", "dialogue", F.col("type").alias("label"))
            model = fitting.fit_retriever(rows, training.triplets(rows))
        promote(store, {a.model: store.stage(model.table(spark), a.model)})
        return
    if a.command == "split":
        rows = readers.read_report(spark, a.input).select(F.col("transcript_id").alias("key"), "labels")
        sinks.write_split(training.multilabel_split(rows, a.train_size, a.seed), a.output)
        return
    c = config.load(a.config)
    table = rules.select_rules(rules.read_rules(spark, a.rules), exclude=c["inference"]["exclude"])
    said = _said(spark, a.input, c["inference"]["speakers"])
    if a.command == "report":
        claims = rules.claims(table)
        s = config.settings(c)
        rows = scoring.claim_results(said, claims, scoring.hits(segment.chunks(said, s.chunk_words, s.overlap), claims, s), s)
        sinks.write_run(scoring.rule_results(said, table, rows), a.output)
    else:
        dataset = spark.read.schema(loop.ROW).json(a.dataset) if a.dataset else None
        loop.run_loop(Store(spark, a.output), a.run, said, table, dataset, loop.LoopSettings(config.settings(c), not a.require_human_review))


if __name__ == "__main__":
    main()
