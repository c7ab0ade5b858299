"""Retrieve, verify, and fold claim scores into rule verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sigmoid, words

#: Claims, rules and queries are stated sets, sent to the tasks in blocks of at most so many rows.
BROADCAST_CLAIMS = 100_000


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.5
    low: float = 0.3
    high: float = 0.7
    top_k: int = 5
    chunk_words: int = 20
    overlap: int = 15


def cosine(a: Column, b: Column) -> Column:
    """Of two number arrays of equal length; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def set_cosine(a: Column, b: Column) -> Column:
    """Of two sets of words (arrays without repeats), as vectors of zeros and ones: built-in array functions, no lambda."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(a).cast("double") * F.size(b))), F.lit(0.0))


def lexical_retriever(claim: Column, chunk: Column) -> Column:
    return F.round(set_cosine(claim, chunk), 6)


def lexical_verifier(claim: Column, chunk: Column) -> Column:
    """One sigmoid over a logit that grows with the share of the claim's words in the chunk."""
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(claim, chunk)), F.size(claim)), F.lit(0.0))
    return F.round(sigmoid(8 * share - 4), 6)


def against(rows: DataFrame, stated: DataFrame, size: int | None = None, most: int = BROADCAST_CLAIMS) -> DataFrame:
    """Every row beside every row of a stated set, which is counted and sent to the tasks, in blocks if it is large."""
    size = stated.count() if size is None else size
    blocks = max(1, -(-size // most))
    if blocks == 1:
        return rows.crossJoin(F.broadcast(stated))
    of = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in stated.columns]), F.lit(2 * blocks))  # twice as many, so that none is too large by chance
    parts = [rows.crossJoin(F.broadcast(stated.filter(of == n))) for n in range(2 * blocks)]
    return reduce(DataFrame.unionByName, parts)


def half_up(x: np.ndarray) -> np.ndarray:
    """To six digits as F.round has it: of the shortest decimal number, halves away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.sign(x) * np.floor(scaled + 0.5) / 1e6
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6), strict=True):  # which side these are on, binary numbers can't say
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every row of a times every row of b, summed in the order of the components, as `cosine` does."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += np.multiply.outer(x, y)
    return out


def _nearest(q: pa.Table, c: pa.Table, k: int, run: int = 512) -> pa.Table:
    """query_id, vec_id, score: the k best of a block of candidates for each of a block of queries."""
    told = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if q.num_rows and c.num_rows:
        matrix = lambda t, name: np.stack(t[name].to_numpy()).astype(float)
        length = lambda m: np.sqrt(sum((x * x for x in m.T), np.zeros(len(m))))
        ids, queries = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, m, x = ids[by_id], matrix(c, "embedding")[by_id], matrix(q, "q")
        mine, theirs = length(x), length(m)
        found = []
        for at in range(0, len(x), run):
            best_s, best_i = np.zeros((len(x[at : at + run]), 0)), np.zeros((len(x[at : at + run]), 0), np.int64)
            for to in range(0, len(m), run):
                s = half_up(products(x[at : at + run], m[to : to + run]) / np.multiply.outer(mine[at : at + run], theirs[to : to + run]))
                best_s, best_i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(ids[to : to + run], s.shape)], axis=1)
                order = np.argsort(-best_s, axis=1, kind="stable")[:, :k]  # of equal scores the smaller id, which comes first
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            found.append((np.repeat(queries[at : at + run], best_s.shape[1]), best_i.reshape(-1), best_s.reshape(-1)))
        told = [np.concatenate(z) for z in zip(*found, strict=True)]
    return pa.table([pa.array(z, t) for z, t in zip(told, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int, size: int, block: int = 8192) -> DataFrame:
    """query_id, vec_id, score, rank of each query's most similar candidates. size: how many queries there are, checked by the caller.

    Blocks of queries meet blocks of candidates, each pair in a task, which multiplies them in the order that `cosine` does and hands
    on the k best. Vectors that have no cosine with all others (null, of another length, all zero or not finite) go the plain way."""
    q = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    c = candidates.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    told = q.agg(F.max(F.size("q")).alias("d")).first()["d"] or 0
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    plain = lambda v: (F.size(v) == told) & F.coalesce((squares(v) > 1e-280) & (squares(v) < 1e280), F.lit(False))
    clean = lambda df, v: df.filter(F.coalesce(plain(F.col(v)), F.lit(False)))
    odd = lambda df, v: df.filter(~F.coalesce(plain(F.col(v)), F.lit(False)))
    blocks = max(1, -(-size // block))
    pieces = max(1, -(-c.count() // block))
    of = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = clean(q, "q").select("query_id", "q", of("query_id", blocks).alias("q_block"), each(pieces).alias("q_piece"))
    right = clean(c, "embedding").select("vec_id", "embedding", of("vec_id", pieces).alias("c_piece"), each(blocks).alias("c_block"))
    met = left.groupBy("q_block", "q_piece").cogroup(right.groupBy("c_block", "c_piece")).applyInArrow(lambda a, b: _nearest(a, b, k), "query_id long, vec_id long, score double")
    score = F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score")
    rest = [against(c, odd(q, "q")), against(odd(c, "embedding"), clean(q, "q"))]
    pairs = reduce(DataFrame.unionByName, [met, *(r.select("query_id", "vec_id", score) for r in rest)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def hits(chunks: DataFrame, claims: DataFrame, s: Settings = Settings(), retrieve: Callable = lexical_retriever, verify: Callable = lexical_verifier) -> DataFrame:  # noqa: B008
    """transcript_id, claim_id, chunk_id, chunk, retr, rank, ver: the best chunks of each transcript for each claim, scored.

    Retriever and verifier see the different words of either side. Only what the retriever keeps meets the verifier."""
    different = lambda x: F.array_distinct(words(F.lower(x)))
    c = claims.select("claim_id", "anchor", different("anchor").alias("claim_words"))
    w = chunks.withColumn("chunk_words", different("chunk"))
    pairs = against(w, c).select("transcript_id", "claim_id", "chunk_id", "chunk", "anchor", retrieve(F.col("claim_words"), F.col("chunk_words")).alias("retr"))
    rank = F.row_number().over(Window.partitionBy("transcript_id", "claim_id").orderBy(F.desc("retr"), "chunk_id"))
    best = pairs.withColumn("rank", rank).filter(F.col("rank") <= s.top_k)
    # The words of what is kept again: cheaper than to sort them with all that is not.
    best = best.withColumns({"claim_words": different("anchor"), "chunk_words": different("chunk")})
    return best.select("transcript_id", "claim_id", "chunk_id", "chunk", "retr", "rank", verify(F.col("claim_words"), F.col("chunk_words")).alias("ver"))


def claim_results(transcripts: DataFrame, claims: DataFrame, hits: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row for each transcript and claim, also without hits: best score (the first of equals), its text, and the hits in the band."""
    in_band = (F.col("ver") >= s.low) & (F.col("ver") < s.high)
    best = F.max_by(F.struct("ver", "retr", "chunk"), F.struct("ver", -F.col("rank")))
    review = F.transform(F.array_sort(F.collect_list(F.when(in_band, F.struct("rank", "chunk", "retr", "ver")))), lambda x: F.struct(x["chunk"].alias("text"), x["retr"].alias("retr"), x["ver"].alias("ver")))
    found = hits.groupBy("transcript_id", "claim_id").agg(best.alias("best"), review.alias("for_review"))
    every = against(transcripts.select("transcript_id"), claims)
    out = every.join(found, ["transcript_id", "claim_id"], "left")
    ver = F.coalesce("best.ver", F.lit(0.0))
    return out.select(
        "transcript_id", "claim_id", "rule_id", "claim_type", "claim_ord", "anchor", ver.alias("ver"), F.coalesce("best.retr", F.lit(0.0)).alias("retr"), F.coalesce("best.chunk", F.lit("")).alias("text"),
        (F.col("best").isNotNull() & (ver >= s.threshold)).alias("passed"), F.coalesce("for_review", F.array().cast("array<struct<text:string,retr:double,ver:double>>")).alias("for_review"),
    )


def rule_results(transcripts: DataFrame, rules: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """transcript_id, rule_id, kind, passed, score, evidence, n_review, for_review of every transcript and rule.

    single: the first claim decides. mandatory: all must pass, the weakest is the evidence. standard: one must
    pass, the best is the evidence. mixed: both; the score is the smaller of the two, the evidence the weakest
    mandatory claim if those failed, else the best standard one. Without claims a rule fails with score 0.
    for_review is null where the rule passed; else it has the hits of the claims at fault."""
    mand, std, one = (F.col("claim_type") == t for t in ("mandatory", "standard", "single"))
    pick = F.struct("text", "ver", "claim_id")
    low, high = F.struct("ver", "claim_id"), F.struct("ver", -F.col("claim_id"))
    failed = F.struct("claim_id", "for_review")
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(c & ~F.col("passed"), failed))), lambda x: x["for_review"]))
    a = claim_rows.groupBy("transcript_id", "rule_id").agg(
        F.count_if(mand).alias("n_m"), F.count_if(std).alias("n_s"),
        F.min_by(F.struct("text", "ver", "passed"), F.when(one, F.col("claim_id"))).alias("single"),
        F.coalesce(F.bool_and(F.when(mand, F.col("passed"))), F.lit(True)).alias("m_pass"), F.coalesce(F.bool_or(F.when(std, F.col("passed"))), F.lit(False)).alias("s_pass"),
        F.min_by(pick, F.when(mand, low)).alias("weakest"), F.max_by(pick, F.when(std, high)).alias("best"),
        flat(one).alias("r_one"), flat(mand).alias("r_m"), flat(std).alias("r_s"),
    )
    kind = F.when(F.col("single").isNotNull(), "single").when((F.col("n_m") > 0) & (F.col("n_s") > 0), "mixed").when(F.col("n_m") > 0, "mandatory").when(F.col("n_s") > 0, "standard").otherwise("empty")
    every = against(transcripts.select("transcript_id"), rules.select("rule_id", "rule_pos"))
    out = every.join(a, ["transcript_id", "rule_id"], "left").withColumn("kind", kind)
    k = F.col("kind")
    passed = F.when(k == "single", F.col("single.passed")).when(k == "mandatory", F.col("m_pass")).when(k == "standard", F.col("s_pass")).when(k == "mixed", F.col("m_pass") & F.col("s_pass")).otherwise(F.lit(False))
    score = F.when(k == "single", F.col("single.ver")).when(k == "mandatory", F.col("weakest.ver")).when(k == "standard", F.col("best.ver")).when(k == "mixed", F.least("weakest.ver", "best.ver")).otherwise(F.lit(0.0))
    text = F.when(k == "single", F.col("single.text")).when(k == "mandatory", F.col("weakest.text")).when(k == "standard", F.col("best.text")).when(k == "mixed", F.when(~F.col("m_pass"), F.col("weakest.text")).otherwise(F.col("best.text"))).otherwise(F.lit(""))
    none = F.array().cast("array<struct<text:string,retr:double,ver:double>>")
    review = F.when(k == "single", F.col("r_one")).when(k == "mandatory", F.col("r_m")).when(k == "standard", F.col("r_s")).when(k == "mixed", F.when(~F.col("m_pass"), F.col("r_m")).otherwise(F.col("r_s"))).otherwise(none)
    out = out.select("transcript_id", "rule_id", "rule_pos", "kind", passed.alias("passed"), score.alias("score"), text.alias("evidence"), review.alias("review"))
    return out.select("transcript_id", "rule_id", "rule_pos", "kind", "passed", "score", "evidence", F.when(~F.col("passed"), F.size("review")).alias("n_review"), F.when(~F.col("passed"), F.col("review")).alias("for_review"))


def report_pivot(rule_rows: DataFrame, rule_ids: list[str]) -> DataFrame:
    """transcript_id, a score for each rule, and the ids of passed rules or NONE. Missing rules score 0."""
    of = lambda r: F.round(F.coalesce(F.first(F.when(F.col("rule_id") == r, F.col("score")), ignorenulls=True), F.lit(0.0)), 4).alias(f"rule_{r}")
    passed = F.array_sort(F.collect_list(F.when(F.col("passed"), F.struct("rule_pos", "rule_id"))))
    out = rule_rows.groupBy("transcript_id").agg(*[of(r) for r in rule_ids], passed.alias("p"))
    listed = F.array_join(F.transform("p", lambda x: x["rule_id"]), ", ")
    return out.withColumn("COMPLIANT", F.when(F.size("p") > 0, listed).otherwise(F.lit("NONE"))).drop("p")


def annotation_payload(rule_rows: DataFrame, rules: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """transcript_id, rule_id, payload: JSON whose shape follows the kind of the rule."""
    entry = F.struct(F.col("claim_type"), F.col("anchor"), F.col("text").alias("best_text"), F.col("ver").alias("verification_score"))
    listed = claim_rows.groupBy("transcript_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("claim_id"), entry.alias("e")))), lambda x: x["e"]).alias("claims"))
    about = rules.select("rule_id", "description", F.col("purpose").alias("purpose_of_control"), "criteria")
    out = rule_rows.join(F.broadcast(about), "rule_id").join(listed, ["transcript_id", "rule_id"], "left")
    common = ["description", "purpose_of_control", "criteria"]
    one = F.to_json(F.struct(*common, F.get("claims", F.lit(0)).alias("claims")))
    several = F.to_json(F.struct(*common, "claims"))
    bare = F.to_json(F.struct(*common, F.col("score").alias("verification_score")))
    payload = F.when(F.col("kind") == "single", one).when(F.col("kind") == "empty", bare).otherwise(several)
    return out.select("transcript_id", "rule_id", "kind", payload.alias("payload"))


def status_counts(rule_rows: DataFrame) -> DataFrame:
    return rule_rows.groupBy("rule_id").agg(F.count_if("passed").alias("n_pass"), F.count_if(~F.col("passed")).alias("n_fail"))
