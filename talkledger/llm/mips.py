"""Exact top-k inner products by norm-bucketed retrieval (operator 2).

Vectors are ordered by length and cut into buckets of some `bucket` rows. Queries first
meet the bucket of the longest vectors, which gives each a k-th best score, its threshold.
In every other bucket, threshold / (length of the query x greatest length in the bucket)
is the least cosine that a better vector has there. Over 1, the bucket is skipped. If it is
high, vectors are pruned by coordinates: on the query's largest coordinates, a vector of at
least that cosine lies within a known interval. Else they are pruned by length alone. The
products of what is left are computed exactly and compared.

Queries are dealt to blocks by the least length of a vector that can still serve them, and meet
the buckets block by block. A task holds one block and one run of neighbouring buckets, both
bounded by rows and by bytes, and takes its buckets from the longest on, its thresholds rising. Pairs
whose vectors no query of the block can use are never formed: a block of undemanding queries meets
all runs, one of demanding queries the first few. Without pruning, N vectors and Q queries would
be shuffled N * Q / block + Q * N / run times.

Defined cases: null vectors, those with a null or non-finite component, and rows without a
vec_id take no part; repeated rows count once, a query's own are all rows of its vec_id;
shorter vectors are as if padded by zeros; ties go to the smaller vec_id; scores beyond the
range of a long are held at its ends; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K = 5
SCALE = 256
BUCKET = 2048
RUN = 8192  # vectors of neighbouring buckets in one task
BLOCK = 8192  # queries
UNIT_BYTES = 64 << 20  # of the vectors of a run, and of a block
FOCUS = 3  # coordinates
HIGH = 0.6  # least cosine from which coordinates prune
_RESULT = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long), norm of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null").filter(finite)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")).distinct()
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(bounds)
    at = np.arange(width) < sizes[:, None]
    out[at] = values[bounds[0] : bounds[-1]]
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns), default=0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all partial sums are whole numbers below 2^53."""
    largest = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), ends.min, ends.max).astype(np.int64)


def probe(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """(query_id, vec_id, score) of each query's k best of one bucket, among those of at least its threshold."""
    qn, cn = np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(c.astype(float), axis=1)
    by = np.lexsort((c_ids, -cn))
    c_ids, c, cn = c_ids[by], c[by], cn[by]
    longest = cn[0] if len(cn) else 0.0
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * longest > 0, theta / (qn * longest), np.where(theta > 0, np.inf, -np.inf))
        reach = np.where(qn > 0, theta / qn, -np.inf)
    alive = np.flatnonzero(local <= 1 + slack)
    unit = c / np.maximum(cn, 1e-300)[:, None]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])

    def keep(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= theta[i]) & (c_ids[rows] != q_ids[i])
        rows, scores = rows[ok], scores[ok]
        if len(rows) > k:
            bound = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= bound], scores[scores >= bound]
        best = np.lexsort((c_ids[rows], -scores))[:k]
        out[0].extend([int(q_ids[i])] * len(best))
        out[1].extend(c_ids[rows[best]].tolist())
        out[2].extend(scores[best].tolist())

    by_length = []
    for i in alive:
        # Length: only the first vectors are long enough.
        n = int(np.searchsorted(-cn, -(reach[i] * (1 - slack) if reach[i] > 0 else reach[i]), side="right")) if reach[i] > 0 else len(cn)
        if local[i] < HIGH:
            by_length.append((i, n))
            continue
        direction, width = q[i] / qn[i], np.arccos(min(1.0, local[i]))
        rows = np.arange(n)
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            angle = np.arccos(np.clip(direction[f], -1, 1))
            top, bottom = np.cos(max(0.0, angle - width)) + slack, np.cos(min(np.pi, angle + width)) - slack
            rows = rows[(unit[rows, f] <= top) & (unit[rows, f] >= bottom)]
        if len(rows):
            keep(i, rows, _products(q[i : i + 1], c[rows])[0])
    for at in range(0, len(by_length), 256):
        some = by_length[at : at + 256]
        n = max(n for _, n in some)
        scores = _products(q[[i for i, _ in some]], c[:n])
        for (i, n), s in zip(some, scores):  # noqa: B905
            keep(i, np.arange(n), s[:n])
    return out


def _meet(queries: pa.Table, candidates: pa.Table, k: int, bucket: int) -> pa.Table:
    found: list[tuple] = []
    if queries.num_rows and candidates.num_rows:
        width = _width(queries["v"], candidates["v"])
        q_ids, q, theta = queries["vec_id"].to_numpy(), _matrix(queries["v"], width), queries["theta"].to_numpy().copy()
        c_ids, c = candidates["vec_id"].to_numpy(), _matrix(candidates["v"], width)
        by = np.lexsort((c_ids, -np.linalg.norm(c.astype(float), axis=1)))
        names, named = np.unique(q_ids, return_inverse=True)
        for at in range(0, len(by), bucket):
            rows = by[at : at + bucket]
            found.append(probe(q_ids, q, theta, c_ids[rows], c[rows], k))
            # A query's k-th best of this run so far.
            ids, scores = (np.concatenate([np.array(f[n], np.int64) for f in found]) for n in (0, 2))
            order = np.lexsort((-scores, ids))
            ids, scores = ids[order], scores[order]
            kth = np.arange(len(ids)) - np.searchsorted(ids, ids) == k - 1
            best = np.full(len(names), -np.inf)
            best[np.searchsorted(names, ids[kth])] = scores[kth]
            theta = np.maximum(theta, best[named])
    return pa.table([pa.array([x for f in found for x in f[n]], pa.int64()) for n in range(3)], names=["query_id", "vec_id", "score"])


def _ranges(df: DataFrame, parts: int, order: list[Column | str], name: str) -> DataFrame:
    """df, written, with a column `name`: in which of `parts` ranges of the order a row is.

    A cluster may split into more partitions than asked for; neighbours then share a range."""
    df = materialize(df.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), f"mips-{name}")
    top = df.agg(F.max("pid")).first()[0]
    return df.withColumn(name, F.floor(F.col("pid") * F.lit(parts) / F.lit(max(parts, (top or 0) + 1))).cast("int")).drop("pid")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, bucket: int = BUCKET, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other vectors (vec_id, v, norm)."""
    vectors = materialize(vectors, "mips-vectors")
    n, wide = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    fit = max(1, UNIT_BYTES // (8 * max(1, wide)))
    parts = max(1, -(-n // min(run, fit)))
    ordered = _ranges(vectors, parts, [F.desc("norm"), F.asc("vec_id")], "run")
    queries = vectors.filter(is_query)
    blocks = max(1, -(-queries.count() // min(block, fit)))
    bounds = materialize(ordered.groupBy("run").agg(F.max("norm").alias("longest")), "mips-bounds")

    def meet(q: DataFrame, pairs: DataFrame) -> DataFrame:
        left = q.join(pairs, "block").select(F.col("block").alias("l_block"), F.col("run").alias("l_run"), "vec_id", "v", "theta")
        right = ordered.join(pairs, "run").select(F.col("block").alias("r_block"), F.col("run").alias("r_run"), "vec_id", "v")
        both = left.groupBy("l_block", "l_run").cogroup(right.groupBy("r_block", "r_run"))
        return both.applyInArrow(lambda a, b: _meet(a, b, k, bucket), _RESULT)

    every = vectors.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    # The run of the longest vectors gives every query a threshold.
    first = bounds.orderBy("run").limit(1).select("run")
    start = every.select("block", F.lit(1).alias("one")).join(first.withColumn("one", F.lit(1)), "one").drop("one")
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    seen = materialize(meet(dealt.withColumn("theta", F.lit(float("-inf"))), start), "mips-first")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    kth = seen.withColumn("rank", best).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("theta"))
    queries = queries.join(kth, "vec_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    # The least length that a query can use; blocks are ranges of it.
    queries = queries.withColumn("need", F.when(F.col("norm") > 0, F.col("theta") / F.col("norm")).when(F.col("theta") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    queries = _ranges(queries, blocks, ["need", "vec_id"], "block")
    need = queries.groupBy("block").agg(F.min("need").alias("need"))
    others = bounds.join(first, "run", "left_anti")
    runs = F.broadcast(others) if parts <= 100_000 else others  # two numbers for each run
    pairs = need.select("block", "need", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("run")).join(runs, "run")
    pairs = pairs.filter(F.col("longest") >= F.col("need") * (1 - 1e-9)).select("block", "run")
    found = seen.unionByName(meet(queries, pairs))
    return found.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame, every: int = 50) -> DataFrame:
    return top_k(quantised(embeddings), F.col("vec_id") % every == 0)


def oracle_sql(every: int = 50, k: int = K, scale: int = SCALE) -> str:
    return f"""
    with e as (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
               where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
          from e q join e c on q.vec_id % {every} = 0 and c.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {k}
    """
