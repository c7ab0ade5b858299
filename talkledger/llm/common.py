"""What the operators of this subpackage share: the shared folder, cut lineage,
and ranks that never gather one key in one task."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_OWN: set[tuple[str, str]] = set()  # application, folder
_SCRATCH: list[list[str]] = []  # the tables of each open `scratch`


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (local runs only) our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, within one of this application that goes when Python ends.

    Results are lazy and read from these tables, so they can't go earlier; `drop_tables` is for callers that are done."""
    own = f"{shared_dir(spark)}/talkledger/{spark.sparkContext.applicationId}"
    if (spark.sparkContext.applicationId, own) not in _OWN:
        _OWN.add((spark.sparkContext.applicationId, own))
        atexit.register(drop_tables, spark)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that this application's operators wrote on the way, once their results were read."""
    if spark.sparkContext._jsc is None:  # the session has ended, and nobody can delete any more
        return
    for own in [o for o in _OWN if o[0] == spark.sparkContext.applicationId]:
        drop_folder(spark, own[1])
        _OWN.discard(own)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files outlive any executor, so a lost one costs a task, not the stages before."""
    path = new_folder(df.sparkSession, tag)
    for own in _SCRATCH[-1:]:
        own.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path__ = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `materialize` writes within are deleted at its end, but for those that were handed to what it gives."""
    own: list[str] = []
    _SCRATCH.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df.path__)
        for outer in _SCRATCH[-2:-1]:  # it is the enclosing one's from now on
            outer.append(df.path__)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.remove(own)
        for path in own:
            drop_folder(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over: else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(df_or_spark, path: str) -> None:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 256) -> int:
    """How many buckets keep each near per_bucket rows, whatever the input's size."""
    return max(least, -(-rows // per_bucket))


def bucketed_prefix(df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str, spread: Column, buckets: int) -> DataFrame:
    """Exclusive running sum of amount within keys, without gathering a key in one task.

    Rows are dealt by (keys, bucket of spread), summed within; then the bucket totals,
    at most `buckets` rows for each key, give each bucket's offset."""
    b, a, within, total = f"{out}__b", f"{out}__a", f"{out}__w", f"{out}__t"
    dealt = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int")).withColumn(a, amount.cast("long"))
    inner = Window.partitionBy(*keys, b)
    running = inner.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn(within, F.sum(a).over(running) - F.col(a))
    sums = dealt.groupBy(*keys, b).agg(F.sum(a).alias(total))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.withColumn(out, F.sum(total).over(across) - F.col(total)).drop(total)
    return dealt.join(offsets, [*keys, b]).withColumn(out, F.col(out) + F.col(within)).drop(b, a, within)


def bound_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Bound what Arrow hands to Python at once, by rows and by bytes, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def components(edges: DataFrame, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of an undirected graph given as edges (a, b).

    Alternating large-star and small-star steps. Minima are aggregates with map-side
    combine, joined back to a materialised table, so a node with very many links is
    split by the skew join and never collected."""
    spark = edges.sparkSession
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, f"{tag}-edges")
    before = None
    for _ in range(most_rounds):
        old = e
        with scratch(spark) as keep:
            # Large star: the larger neighbours of u point at u's smallest neighbour, or u.
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{tag}-low")
            large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = materialize(large.filter("a <> b").distinct(), f"{tag}-large")
            # Small star: u and its smaller neighbours point at the smallest of them.
            low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{tag}-small")
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
            e = keep(materialize(small.filter("a <> b").distinct(), f"{tag}-edges"))
        drop_folder(spark, old.path__)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.path__ = e.path__
    return out
