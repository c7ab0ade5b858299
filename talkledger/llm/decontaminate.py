"""Benchmark decontamination (operator 9): DataFrame functions only.

The benchmark's windows of `n` consecutive words (an item of fewer words is one window)
form a hash set. Every document's windows are hashed in one pass over its words: hashes of two, four and
more words are made of each other, and a window's of the two that cover it, so all its words count and frequent
words at its ends bring no candidates. It is looked up in the set, which is broadcast
if its counted size allows that; else what a bit filter of fixed size lets pass meets the set in a shuffle. Then all words of the window
are compared, for which in the second case only documents with candidates are fetched. Hits mark
words, or remove spans or documents.

Words: A-Z in lower case, runs of WORD. Defined cases: a null text has no words, a null
item no windows; an item without an id marks words but isn't counted; rows with the
same doc_id and text (also null ids) get the same result, each its own row; an empty
benchmark hits nothing; columns besides the named ones are ignored or, in `remove_hits`,
handed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are in lower case.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between words. Splitting there is several times as fast as extracting the words.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Up to so many windows are broadcast: some 200 bytes each, 40 MB in all.
BROADCAST_WINDOWS = 200_000
#: Bits of the filter before a shuffle, in words of 64, which are at most as many rows of two numbers: some 20 MB.
FILTER_BITS = 1 << 25


def words_of(text: Column) -> Column:
    """The words as they are written; what counts is `_plain` of them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_GAP, -1), "")


def _plain(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def hashed(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df (words) exploded: len, at, h of each place and size of window.

    h is made of the hashes of the first and the last k words, k the largest power of two in the window, which are made of those
    of half as many: a word is hashed once, however long the windows, in
    lower case beyond ASCII too, which is faster. The last places of a text have windows that end beyond it, and a
    text without words has a row of nulls (outer: else the optimizer asks below for arrays that aren't empty, and
    computes all of this twice). Both match nothing once words are compared."""
    kept = df.columns
    both = lambda x, y: F.xxhash64(x, y)
    behind = lambda of, n: F.slice(of, n + 1, F.size("words"))
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    widest = lambda n: 1 << (n.bit_length() - 1)
    k = 1
    while k < widest(max(sizes)):
        df = df.withColumn(f"h{2 * k}", F.zip_with(f"h{k}", behind(f"h{k}", k), both))
        k *= 2
    of = lambda n: F.col(f"h{n}") if n == widest(n) else F.zip_with(f"h{widest(n)}", behind(f"h{widest(n)}", n - widest(n)), both)
    if len(sizes) == 1:
        return df.select(*kept, F.posexplode_outer(of(sizes[0])).alias("at", "h")).withColumn("len", F.lit(sizes[0]))
    parts = [F.transform(of(n), lambda h, i: F.struct(F.lit(n).alias("len"), i.alias("at"), h.alias("h"))) for n in sizes]  # noqa: B023
    return df.select(*kept, F.inline_outer(F.concat(*parts)))


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """len, h, key (the words), items: one row for each different window."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    size = F.size("words")
    w = hashed(w, list(range(1, n + 1))).filter((size > 0) & (F.col("len") == F.least(size, F.lit(n))) & (F.col("at") + F.col("len") <= size))
    w = w.select("item_id", "len", "h", _plain(F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ")).alias("key"))
    return w.groupBy("len", "h", "key").agg(F.collect_set("item_id").alias("items"))


def passed(rows: DataFrame, windows: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows whose h may be one of the windows': the others are sure not to be. The filter is as large for any number of windows."""
    at = F.pmod(F.col("h"), F.lit(bits))
    word, bit = F.floor(at / 64).cast("int"), (at % 64).cast("int")
    held = windows.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(held), "word").filter(F.getbit("bits", bit) == 1).drop("word", "bits")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, tkey, spans (start, end in words, sorted), items: one row for each document with hits."""
    windows = materialize(item_windows(benchmark, n), "bench-windows")
    by_len = {r["len"]: r["c"] for r in windows.groupBy("len").agg(F.count(F.lit(1)).alias("c")).collect()}  # n rows at most
    sizes = sorted(by_len) or [n]
    tokens = docs.select("doc_id", _key(F.col("text")).alias("tkey"), words_of(F.col("text")).alias("words"))
    if sum(by_len.values()) <= broadcast_windows:
        scanned = hashed(tokens, sizes)
        hit = scanned.join(F.broadcast(windows.withColumnRenamed("len", "w_len")), "h")
    else:
        scanned = passed(hashed(tokens, sizes).select("tkey", "len", "at", "h"), windows)
        hit = scanned.join(windows.select("h").distinct(), "h", "left_semi").distinct()
        hit = materialize(hit.groupBy("tkey").agg(F.collect_list(F.struct("len", "at", "h")).alias("runs")), "bench-candidates")  # at most a document's words
        hit = tokens.join(hit, "tkey").select("doc_id", "tkey", "words", F.inline("runs")).join(windows.withColumnRenamed("len", "w_len"), "h")
    # Not a plain equality, which the optimizer would make a join key and so join the words of all windows to strings.
    said = _plain(F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " "))
    hit = hit.filter((F.col("len") == F.col("w_len")) & (F.least(said, F.col("key")) == F.greatest(said, F.col("key"))))
    found = hit.select("doc_id", "tkey", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("end")).alias("span"), "items")
    return found.groupBy("doc_id", "tkey").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def _joined(docs: DataFrame, hits: DataFrame) -> DataFrame:
    h = hits.withColumnsRenamed({"doc_id": "h_id", "tkey": "h_key", "spans": "h_spans", "items": "h_items"})
    return docs.join(h, docs["doc_id"].eqNullSafe(h["h_id"]) & docs["tkey"].eqNullSafe(h["h_key"]), "left")


def mark_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    hits = find_hits(docs, benchmark, n, broadcast_windows)
    counted = docs.select("doc_id", _key(F.col("text")).alias("tkey"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = _joined(counted, hits)
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.array_sort(F.transform("h_items", lambda i: i.cast("string"))), none)
    n_hit = F.coalesce(covered(F.col("h_spans")), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float = 0.5, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs without hit words and what follows each up to the next word; documents of which
    more than drop_share of the words are hit go whole. All columns of docs stay."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, n, broadcast_windows)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text").withColumn("tkey", _key(F.col("text")))
    out = _joined(packed, hits)
    # Spans merged first: a word is then looked up in few.
    merged = F.aggregate(
        "h_spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when(
            F.get(a, F.size(a) - 1)["end"] >= s["start"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    hit = F.col("h_spans").isNotNull()
    out = out.withColumn("merged", F.when(hit, merged)).withColumn("raw", F.when(hit, F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0)))).withColumn("gaps", F.when(hit, F.split("text", RAW_WORD, -1)))
    kept = F.transform(
        "raw", lambda w, i: F.when(F.exists("merged", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(F.concat(w, F.get("gaps", i + 1)))
    )
    share = covered(F.col("merged")) / F.size("raw")
    out = out.filter(~hit | (share <= drop_share))
    out = out.withColumn("clean", F.when(hit, F.concat(F.get("gaps", F.lit(0)), F.array_join(kept, ""))).otherwise(F.col("text")))
    return out.select(*[(F.col("clean") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def oracle_sql(n: int = WINDOW) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
    with d as (select doc_id, {words} as w from documents),
    b as (select item_id, {words} as w from benchmark),
    bl as (select item_id, w, least(len(w), {n}) as l from b where len(w) > 0),
    iw as (select distinct item_id, l, array_to_string(w[p + 1 : p + l], ' ') as k
           from (select item_id, w, l, unnest(range(0, len(w) - l + 1)) as p from bl)),
    ls as (select distinct l from iw),
    dp as (select doc_id, w, l, unnest(range(0, len(w) - l + 1)) as p from d, ls where len(w) >= l),
    dw as (select doc_id, l, p, array_to_string(w[p + 1 : p + l], ' ') as k from dp),
    hits as (select doc_id, dw.l, p, item_id from dw join iw on dw.l = iw.l and dw.k = iw.k),
    marked as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from hits) group by doc_id),
    named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join marked using (doc_id) left join named using (doc_id)
    """
