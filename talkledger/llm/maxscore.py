"""Ranked lexical search by MaxScore in every shard (operator 11).

One pass over the documents keeps, for each, its length and how often it holds each word of the
items: the postings, a fraction of the texts, are written to the shared folder. Counts over all of
them (N, L, df) fix the weights. Every partition of the postings is then a shard that ranks its own
documents: windows of them are turned into one list for each word, with the greatest score any
document of the window has from it, its upper bound. For an item, words are ordered by their bounds.
Those whose bounds together stay below the k-th best score of the shard so far are non-essential: no
document can qualify with them alone. Candidates come from the lists of the other, essential words; the
non-essential lists are probed from the highest bound on, and only for candidates that what is left can
still lift to the k-th best score. All scores are whole numbers, so bounds are exact and nothing is lost.
Each shard gives at most k rows an item, of which the best k are kept.

Items are a stated query set. They are dealt to blocks of some BLOCK_WORDS different words, each of which
is one pass, so that what tasks hold does not grow with their number.

Defined cases: a null text has no words and takes no part; neither does an item without words, and an item that shares no
word with a document ranks none; rows with the same doc_id are documents of their own, also null ids, which come last
among equal scores; item rows equal in item_id and text are one item, those equal in item_id only are ranked apart; an
empty table gives an empty result; columns besides doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, materialize

K = 10
BLOCK_WORDS = 200_000  # of the items that one pass serves
WINDOW_DOCS = 4096  # documents whose lists are built at once
WINDOW_PLACES = 1 << 20  # and their postings
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as UTF-8 to bytes of words, all that separates them becoming a space.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_POSTINGS = "doc_id long, n long, words array<int>, times array<int>"
_BEST = "item int, doc_id long, score long"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.translate(PLAIN).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def item_words(items: DataFrame) -> DataFrame:
    """item_id, tkey, word (binary), times of every different item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, words, times = [], [], [], []
            for i, k, t in zip(batch.column("item_id").to_pylist(), batch.column("tkey").to_pylist(), _texts(batch), strict=True):
                found = Counter(words_of(t))
                ids.extend([i] * len(found))
                keys.extend([k] * len(found))
                words.extend(found)
                times.extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["item_id", "tkey", "word", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    return rows.withColumn("tkey", F.sha2(F.col("text").cast("binary"), 256)).mapInArrow(split, "item_id long, tkey string, word binary, times long")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all words of the text), words and times: which words of the vocabulary it holds, how often."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value.get
        for batch in batches:
            n, ends, words, times = [], [0], [], []
            for text in _texts(batch):
                said = words_of(text)
                found = Counter(map(known, said))
                found.pop(None, None)
                n.append(len(said))
                words.extend(found)
                times.extend(found.values())
                ends.append(len(words))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (words, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "words", "times"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").mapInArrow(count, _POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Lists:
    """The lists of one window of documents: of each slot, docs[start:end] hold the word, for which they score c."""

    n_docs: int
    slot: np.ndarray  # of each word, or -1
    start: np.ndarray
    docs: np.ndarray
    c: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, sizes: np.ndarray, words: np.ndarray, times: np.ndarray, w: np.ndarray, n_docs: int, length: int) -> Lists:
        docs = np.repeat(np.arange(len(n)), sizes)
        m = 25 + (75 * n.astype(np.int64) * n_docs) // length
        tf = times.astype(np.int64)
        c = w[words] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        by = np.argsort(words, kind="stable")
        words, docs, c = words[by], docs[by], c[by]
        first = np.flatnonzero(np.diff(words, prepend=-1))
        slot = np.full(len(w), -1)
        slot[words[first]] = np.arange(len(first))
        return cls(len(n), slot, np.append(first, len(words)), docs, c, np.maximum.reduceat(c, first) if len(first) else c)


def max_score(lists: Lists, words: np.ndarray, times: np.ndarray, least: int, probed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the window that score at least `least` (over 0) for an item, with their scores.

    `probed` gets how many postings each list was asked for."""
    slots = lists.slot[words]
    held = slots >= 0
    slots, times = slots[held], times[held]
    bounds = lists.bound[slots] * times
    by = np.argsort(bounds, kind="stable")
    slots, times, reach = slots[by], times[by], np.cumsum(bounds[by])
    essential = int(np.searchsorted(reach, least))
    scores = np.zeros(lists.n_docs, np.int64)
    for s, q in zip(slots[essential:], times[essential:], strict=True):
        a, b = lists.start[s], lists.start[s + 1]
        scores[lists.docs[a:b]] += lists.c[a:b] * q
        if probed is not None:
            probed.append(int(b - a))
    docs = np.flatnonzero(scores)
    for i in range(min(essential, len(slots)) - 1, -1, -1):
        docs = docs[scores[docs] + reach[i] >= least]
        if not len(docs):
            break
        a, b = lists.start[slots[i]], lists.start[slots[i] + 1]
        at = np.searchsorted(lists.docs[a:b], docs)
        hit = lists.docs[a + np.minimum(at, b - a - 1)] == docs
        scores[docs[hit]] += lists.c[a + at[hit]] * times[i]
        if probed is not None:
            probed.append(len(docs))
    docs = docs[scores[docs] >= least]
    return docs, scores[docs]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a shard in tables of about WINDOW_DOCS documents."""
    some, rows, places = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, WINDOW_DOCS):
            part = batch.slice(at, WINDOW_DOCS)
            some.append(part)
            rows += part.num_rows
            places += len(part.column("words").flatten())
            if rows >= WINDOW_DOCS or places >= WINDOW_PLACES:
                yield pa.Table.from_batches(some)
                some, rows, places = [], 0, 0
    if rows:
        yield pa.Table.from_batches(some)


def rank_shard(batches: Iterator[pa.RecordBatch], items: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, n_docs: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """item, doc_id, score: the k best documents of a shard for each item (its words and how often it holds them)."""
    none = np.zeros(0, np.int64)
    best = [(none, none, none)] * len(items)  # doc_id, whether it is null, score; the best first
    for window in _windows(batches):
        window = window.combine_chunks()
        words, times = window["words"].combine_chunks(), window["times"].combine_chunks()
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        lists = Lists.of(window["n"].to_numpy(), sizes, words.flatten().to_numpy(), times.flatten().to_numpy(), w, n_docs, length)
        null = window["doc_id"].is_null().to_numpy().astype(np.int64)
        ids = window["doc_id"].fill_null(0).to_numpy()
        for i, (said, often) in enumerate(items):
            least = int(best[i][2][-1]) if len(best[i][2]) == k else 1
            docs, scores = max_score(lists, said, often, max(1, least))
            if len(docs):
                all_of = [np.concatenate(x) for x in zip(best[i], (ids[docs], null[docs], scores), strict=True)]
                top = np.lexsort((all_of[0], all_of[1], -all_of[2]))[:k]
                best[i] = tuple(x[top] for x in all_of)
    for i, (ids, null, scores) in enumerate(best):
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=null.astype(bool)), pa.array(scores)], names=["item", "doc_id", "score"])


def _ranked(docs: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block."""
    spark = docs.sparkSession
    rows = words.orderBy("item_id", "tkey").collect()  # of one block: some BLOCK_WORDS
    vocabulary = {w: i for i, w in enumerate(sorted({bytes(r["word"]) for r in rows}))}
    items: dict[tuple, list[tuple[int, int]]] = {}
    for r in rows:
        items.setdefault((r["item_id"], r["tkey"]), []).append((vocabulary[bytes(r["word"])], r["times"]))
    table = materialize(postings(docs, vocabulary), "postings")
    n_docs, length = table.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = table.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()  # of the block's words
    w = np.zeros(len(vocabulary), np.int64)
    for r in df:
        w[r["word"]] = weight(n_docs, r["df"])
    queries = [(np.array([x for x, _ in said]), np.array([t for _, t in said], np.int64)) for said in items.values()]
    shipped = spark.sparkContext.broadcast((queries, w))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = shipped.value
        return rank_shard(batches, queries, w, n_docs, length, k)

    found = table.filter("size(words) > 0").mapInArrow(rank, _BEST)
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    words = materialize(item_words(items), "item-words")
    blocks = max(1, -(-words.count() // block_words))
    block = F.pmod(F.xxhash64("item_id", "tkey"), F.lit(blocks))
    found = None
    for b in range(blocks):
        part = _ranked(docs, words.filter(block == b), k)
        part = materialize(part, "ranked") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(documents, benchmark)


def oracle_sql(k: int = K) -> str:
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
    with d as (select row_number() over () as row, doc_id, {words} as w from documents where text is not null),
    g as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as total from d where len(w) > 0),
    q as (select item_id, text, word, count(*) as qtf from (select item_id, text, unnest({words}) as word from (select distinct item_id, text from benchmark where text is not null)) group by all),
    t as (select row, word, count(*) as tf from (select row, unnest(w) as word from d) where word in (select word from q) group by all),
    f as (select word, cast(floor(1000 * ln((2 * n_docs + 2) / cast(2 * count(*) + 1 as double))) as bigint) as weight from t, g group by word, n_docs),
    s as (select q.item_id, q.text, d.row, d.doc_id,
                 cast(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n_docs) // total)))) as bigint) as score
          from q join t using (word) join f using (word) join d using (row), g group by all),
    r as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from s where score > 0)
    select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= {k}
    """
