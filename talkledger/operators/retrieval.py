"""Retrieval by an inverted index of the claims: a chunk meets only claims that it shares a word with.

The words of the claims, a stated set, are the index. Chunks are sets of words, cut from a transcript's words; every word of a
chunk looks its claims up, and what is summed for a chunk and a claim is their dot product. Texts are carried by
none of these rows: only the chunks that are kept for a claim are cut from their transcript again, at the end. All steps are
keyed by transcript first, so transcripts that are partitioned by their id are not shuffled.

Words weigh 1 (`words`: the cosine of sets) or, in `tfidf`, their inverse document frequency over all chunks. Frequencies are
kept for a fixed number of buckets of hashed words, so their table does not grow with the vocabulary.

The result is that of comparing every chunk with every claim: chunks without a shared word score 0 and fill up the
k of a claim in the order of their ids. Defined cases: a transcript without words has no chunks; claims without words score
0 everywhere; a null text is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from . import scoring

BUCKETS = 1 << 18
INDEX_ROWS = 1_000_000  # of claims' words that are broadcast; above, the index is joined by a shuffle


def bucket(word: Column, buckets: int = BUCKETS) -> Column:
    """A bucket that any engine can compute."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def chunk_sets(said: DataFrame, s: scoring.Settings) -> DataFrame:
    """transcript_id, chunk_id, set: the different words of each chunk of said (transcript_id, text), in lower case."""
    step = s.chunk_words - s.overlap
    w = said.select("transcript_id", "text", words(F.lower("text")).alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: (i == 0) | (F.size("w") - i >= 2))
    sets = F.when(F.size("w") > s.chunk_words, F.transform(starts, lambda i: F.array_distinct(F.slice("w", i + 1, s.chunk_words)))).when(F.col("text") != "", F.array(F.array_distinct("w")))
    return w.select("transcript_id", F.posexplode(sets).alias("chunk_id", "set"))


def document_frequencies(sets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """word (a bucket), idf: ln((1 + n) / (1 + df)) + 1 over n chunks; at most `buckets` rows."""
    n = sets.agg(F.count(F.lit(1)).alias("n"))
    df = sets.select(F.explode(F.array_distinct(F.transform("set", lambda x: bucket(x, buckets)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def ranked(said: DataFrame, claims: DataFrame, s: scoring.Settings = scoring.Settings(), weigh: str = "words", buckets: int = BUCKETS) -> DataFrame:  # noqa: B008
    """transcript_id, claim_id, chunk_id, retr, rank: the `top_k` chunks of each transcript for each claim (claim_id, anchor)."""
    sets = chunk_sets(said, s)
    c = claims.select("claim_id", F.array_distinct(words(F.lower("anchor"))).alias("set"))
    if weigh == "tfidf":
        as_buckets = lambda df: df.withColumn("set", F.array_distinct(F.transform("set", lambda x: bucket(x, buckets))))
        idf = document_frequencies(sets, buckets)
        sets, c = as_buckets(sets), as_buckets(c)
        known = lambda df, how: df.withColumn("word", F.explode("set")).drop("set").join(F.broadcast(idf), "word", how).withColumn("weight", F.coalesce("idf", F.lit(0.0))).drop("idf")
    if weigh == "words":
        index = c.select("claim_id", F.explode("set").alias("word"), F.lit(1.0).alias("claim_weight"), F.sqrt(F.size("set").cast("double")).alias("claim_norm"))
    else:
        index = known(c, "left")
        norms = index.groupBy("claim_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("claim_norm"))
        index = index.join(norms, "claim_id").select("claim_id", "word", F.col("weight").alias("claim_weight"), "claim_norm")
    index = F.broadcast(index) if index.count() <= INDEX_ROWS else index
    if weigh == "words":
        # The length of a set is known at once.
        said_words = sets.withColumn("norm", F.sqrt(F.size("set").cast("double"))).withColumn("word", F.explode("set")).withColumn("weight", F.lit(1.0)).drop("set")
    else:
        weighed = known(sets, "inner")
        lengths = weighed.groupBy("transcript_id", "chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        said_words = weighed.join(lengths, ["transcript_id", "chunk_id"])
    met = said_words.join(index, "word")
    score = F.round(F.sum(F.col("weight") * F.col("claim_weight")) / (F.first("norm") * F.first("claim_norm")), 6)
    met = met.groupBy("transcript_id", "claim_id", "chunk_id").agg(score.alias("retr"))
    found = met.groupBy("transcript_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("retr")).alias("low"), "chunk_id"))).alias("found"))  # chunks of one transcript
    # How many chunks there are follows from the words.
    step = s.chunk_words - s.overlap
    n = F.size(words(F.coalesce("text", F.lit(""))))
    last = F.floor((n - 1) / step)
    n_chunks = F.when(n > s.chunk_words, F.when(n - last * step >= 2, last + 1).otherwise(last)).when(F.coalesce("text", F.lit("")) != "", 1).otherwise(0).cast("int")
    every = scoring.against(said.select("transcript_id", n_chunks.alias("n_chunks")).filter("n_chunks > 0"), claims.select("claim_id"))
    out = every.join(found, ["transcript_id", "claim_id"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<low:double,chunk_id:int>>")))
    k = s.top_k
    top = F.slice("found", 1, k)
    others = F.array_except(F.sequence(F.lit(0), F.least(F.col("n_chunks"), F.size("found") + k) - 1), F.transform("found", lambda x: x["chunk_id"]))
    rest = F.transform(F.slice(others, 1, k), lambda i: F.struct(F.lit(0.0).alias("low"), i.alias("chunk_id")))
    out = out.select("transcript_id", "claim_id", F.posexplode(F.slice(F.concat(top, rest), 1, k)).alias("at", "hit"))
    return out.select("transcript_id", "claim_id", "hit.chunk_id", F.abs("hit.low").alias("retr"), (F.col("at") + 1).alias("rank"))


def hits(said: DataFrame, claims: DataFrame, s: scoring.Settings = scoring.Settings(), weigh: str = "words", verify: Callable[[Column, Column], Column] | dict[str, Callable] = scoring.lexical_verifier) -> DataFrame:  # noqa: B008
    """transcript_id, claim_id, chunk_id, chunk, retr, rank, ver: what `scoring.hits` gives, without copies of texts on the way.

    verify may be several verifiers by the name of their column: retrieval is the same for all."""
    some = verify if isinstance(verify, dict) else {"ver": verify}
    found = ranked(said, claims, s, weigh)
    step = s.chunk_words - s.overlap
    texts = said.select("transcript_id", "text", words(F.coalesce("text", F.lit(""))).alias("w"))
    cut = F.when(F.size("w") > s.chunk_words, F.array_join(F.slice("w", F.col("chunk_id") * step + 1, F.lit(s.chunk_words)), " ")).otherwise(F.col("text"))
    out = found.join(texts, "transcript_id").select(*found.columns, cut.alias("chunk"))
    c = claims.select("claim_id", F.array_distinct(words(F.lower("anchor"))).alias("claim_words"))
    out = out.join(F.broadcast(c) if claims.count() <= scoring.BROADCAST_CLAIMS else c, "claim_id").withColumn("chunk_words", F.array_distinct(words(F.lower("chunk"))))
    scores = [v(F.col("claim_words"), F.col("chunk_words")).alias(name) for name, v in some.items()]
    return out.select("transcript_id", "claim_id", "chunk_id", "chunk", "retr", "rank", *scores)


