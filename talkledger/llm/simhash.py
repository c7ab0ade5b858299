"""SimHash near-duplicates by a binary trie self-join (operator 5).

A document's fingerprint has a bit for each of 64 positions, set where over half of its
shingles' hashes have it. Equal fingerprints are one node from then on. Two fingerprints
link if they differ in at most `errors` bits.

The trie is split among tasks without loss: cut the 64 bits into errors + k blocks; two
linked fingerprints agree on k blocks at least. For each choice of k blocks, the bits are
reordered so that these come first, and the subtrie under each value of theirs is a unit
of work. Within it, pairs of trie nodes are traversed together from the root down; each
step adds the bit in which they differ, and a pair over the budget is pruned. k grows with
the number of fingerprints, so that subtries stay small. A subtrie over `chunk` members
is dealt to tasks as pairs of chunks. A unit yields a spanning forest of its links, never
all pairs; connected components join these.

Defined cases: null and empty texts have no words and fingerprint zero, which links like
any other; fewer words than a shingle's are one shingle; a null doc_id takes no part in
the smallest id, and a component of such rows only has a null id; repeated rows are rows
as any other; an empty table gives an empty result; other columns are ignored, or handed
through by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, components, drop_folder, free_shuffles, materialize, scratch

BITS = 64
SHINGLE = 4
ERRORS = 4
CHUNK = 8192
LEAF = 256  # pairs: below it, node pairs are compared member by member


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Words are split at ASCII white space, A-Z in lower case (both as bytes.lower and bytes.split have it)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :])]  # noqa: B905
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for i in range(0, n, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs' columns but text, and fp (the 64 bits as a long)."""
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    raw = docs.select(*[f"`{c}`" for c in others], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    schema = raw.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(len(others))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*others, "fp"])

    return raw.mapInArrow(run, schema)


def _blocks(count: int, errors: int, per_unit: int = 64, most: int = 512) -> tuple[list[tuple[int, int]], int]:
    """(offset, bits) of the blocks, and how many of them must agree.

    Each fingerprint is sent once for each choice of k blocks: with 7 errors 8, 36 and 120 times for k of 1, 2 and 3. So from 2 on,
    units grow to `most` before k does."""
    k = 1
    while k < 8 and count >> (BITS * k // (errors + k)) > (per_unit if k == 1 else most):
        k += 1
    n = errors + k
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)], k


def _reordered(fp: np.ndarray, chosen: tuple[int, ...], blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The bits with the chosen blocks on top, and those blocks alone."""
    at, out, key = BITS, np.zeros_like(fp), fp
    for n, i in enumerate([*chosen, *[i for i in range(len(blocks)) if i not in chosen]]):
        offset, bits = blocks[i]
        at -= bits
        out = out | ((fp >> np.uint64(offset)) & np.uint64((1 << bits) - 1)) << np.uint64(at)
        if n == len(chosen) - 1:
            key = out >> np.uint64(at)
    return out, key


def _keyed(fps: DataFrame, choices: list[tuple[int, ...]], blocks: list[tuple[int, int]]) -> DataFrame:
    """choice, key, bits, fp: each fingerprint in the order of each choice. In tasks: as columns, hundreds of choices make a plan that fills the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for n, chosen in enumerate(choices):
                bits, key = _reordered(fp, chosen, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (key, bits, fp))], names=["choice", "key", "bits", "fp"])

    return fps.select("fp").mapInArrow(run, "choice int, key long, bits long, fp long")


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_forest(values: np.ndarray, starts: np.ndarray, depth: int, errors: int) -> np.ndarray:
    """parent of each of the sorted 64-bit values, after uniting those of one run that differ in
    at most `errors` bits. starts: where runs start; a run's members agree on the first `depth` bits."""
    n = len(values)
    parent = np.arange(n)
    ends = np.append(starts[1:], n)
    a0, a1 = starts.astype(np.int64), ends.astype(np.int64)
    keep = a1 - a0 > 1
    a0, a1 = a0[keep], a1[keep]
    b0, b1, dist = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)

    def compare(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        sizes = (a1 - a0) * (b1 - b0)
        bounds = np.searchsorted(np.cumsum(sizes), np.arange(1, sizes.sum() // 1_000_000 + 2) * 1_000_000)
        for lo, hi in zip([0, *bounds], [*bounds, len(sizes)]):  # noqa: B905
            s = sizes[lo:hi]
            if not s.sum():
                continue
            which = np.repeat(np.arange(lo, hi), s)
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            wide = (b1 - b0)[which]
            i, j = a0[which] + k // wide, b0[which] + k % wide
            near = (np.bitwise_count(values[i] ^ values[j]) <= errors) & (i < j)
            _unite(parent, i[near], j[near])

    for level in range(depth, BITS):
        if not len(a0):
            break
        small = (a1 - a0) * (b1 - b0) <= LEAF
        compare(a0[small], a1[small], b0[small], b1[small])
        a0, a1, b0, b1, dist = (x[~small] for x in (a0, a1, b0, b1, dist))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - level)) & np.uint64(1))]).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        more = (dist + 1).astype(np.int8)
        parts = [(a0, am, b0, bm, dist), (am, a1, bm, b1, dist), (a0, am, bm, b1, more)]
        x = ~own
        parts.append((am[x], a1[x], b0[x], bm[x], more[x]))
        a0, a1, b0, b1, dist = (np.concatenate(p) for p in zip(*parts))  # noqa: B905
        alive = (a1 > a0) & (b1 > b0) & (dist <= errors) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, dist = (v[alive] for v in (a0, a1, b0, b1, dist))
    compare(a0, a1, b0, b1)
    return _roots(parent, np.arange(n))


def link_forest(fps: DataFrame, count: int, errors: int = ERRORS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between different fingerprints (fp) that connect all that differ in at most `errors` bits."""
    spark = fps.sparkSession
    blocks, k = _blocks(count, errors)
    choices = list(combinations(range(len(blocks)), k))
    depths = [sum(blocks[i][1] for i in chosen) for chosen in choices]
    keyed = _keyed(fps, choices, blocks)
    large = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > chunk)
    large = materialize(large.select("choice", "key", F.ceil(F.col("c") / chunk).cast("int").alias("chunks")), "simhash-large")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi")))
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    dealt = keyed.join(large, ["choice", "key"], "left").select("choice", "key", "fp", F.explode(F.when(F.col("chunks").isNotNull(), pairs).otherwise(one)).alias("p"))
    dealt = dealt.select("choice", "key", "p.lo", "p.hi", "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(choices) // 400_000)
    dealt = dealt.repartition(parts, "choice", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # the rows of a few units: 28 bytes each
        if not got:
            return
        t = pa.Table.from_batches(got)
        choice, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("choice", "lo", "hi"))
        key, fp = (t.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
        bits = np.zeros_like(fp)
        for n in np.unique(choice):
            at = np.flatnonzero(choice == n)
            bits[at] = _reordered(fp[at], choices[n], blocks)[0]  # again, rather than sent
            at = at[np.lexsort((bits[at], hi[at], lo[at], key[at]))]
            units = np.stack([key[at].view(np.int64), lo[at], hi[at]])
            starts = np.concatenate([[0], np.flatnonzero((units[:, 1:] != units[:, :-1]).any(axis=0)) + 1])
            roots = trie_forest(bits[at], starts, depths[n], errors)
            linked = roots != np.arange(len(at))
            if linked.any():
                a, b = fp[at][linked].view(np.int64), fp[at][roots[linked]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    prints = materialize(fingerprints(docs.select("doc_id", "text"), shingle), "simhash-prints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    links = link_forest(fps.select("fp"), fps.count(), errors)
    roots = components(links, "simhash")
    named = materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-named")
    least = materialize(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    named = materialize(named.join(least, "root").select("fp", "component_id"), "simhash-ids")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, shingle: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = near_duplicates(docs, shingle, errors)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_fingerprint(text: bytes, seed: int = 42) -> int:
    """The fingerprint of the set of words: an edited word moves it far less than that of shingles."""
    hashes = [xxhash.xxh64_intdigest(w, seed) for w in set(text.lower().split())]
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((bits * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[min(shingle, len(words)) - 1 :])], np.uint64))  # noqa: B905


def prefix(own: np.ndarray, least: float, common: np.ndarray, by_hash: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, rarest first, so many that two sets with a Jaccard similarity of `least` or more share one.

    Such sets share at least least * n of the n shingles of either, so not all of these lie behind the first n - ceil(least * n) + 1.
    That holds for any order that is the same for all sets: `common` (most frequent last) only makes chance meetings rare."""
    if not len(own):
        return np.zeros(1, np.uint64)
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own, sorter=by_hash), len(common) - 1)
        rank = np.where(common[by_hash[at]] == own, by_hash[at] + 1, 0)
    n = len(own)
    return own[np.lexsort((own, rank))[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class SetIndex:
    """Sorted sets by their members: what they share with another set is counted for all of them at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        self.members, self.owners = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def holds_similar(self, own: np.ndarray, least: float) -> bool:
        """Whether one of the sets has a `similarity` of `least` or more with another one."""
        if not len(self.sizes):
            return False
        if not len(own):
            return bool((self.sizes == 0).any()) or least <= 0
        lo, hi = np.searchsorted(self.members, own, "left"), np.searchsorted(self.members, own, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = np.bincount(self.owners[at], minlength=len(self.sizes))
        return bool((both / (self.sizes + len(own) - both) >= least).any())


def _greedy(frame: pd.DataFrame, shingle: int, least: float, step: int = 64) -> pd.DataFrame:
    """tkey, kept of one component's batch, by rank: a text that is similar to no kept one before it is kept.

    Those kept are an index, made anew for every `step` more of them; only these are compared one by one."""
    kept: list[np.ndarray] = []
    fresh: list[np.ndarray] = []
    index = SetIndex(kept)
    out = []
    for tkey, text in frame.sort_values("rank")[["tkey", "text"]].itertuples(index=False):
        own = shingle_hashes(bytes(text), shingle)
        new = not index.holds_similar(own, least) and not any(similarity(own, k) >= least for k in fresh if min(len(k), len(own)) >= least * max(len(k), len(own)) - 1e-6)
        if new:
            fresh.append(own)
            if len(fresh) >= step:
                kept, fresh = kept + fresh, []
                index = SetIndex(kept)
        out.append((tkey, new))
    return pd.DataFrame(out, columns=["tkey", "kept"])


def _held_against(rest: pd.DataFrame, leads: pd.DataFrame, shingle: int, least: float) -> pd.DataFrame:
    """tkey, same: whether each text of rest is similar to any of leads."""
    index = SetIndex([shingle_hashes(bytes(t), shingle) for t in leads["text"]])
    same = [index.holds_similar(shingle_hashes(bytes(t), shingle), least) for t in rest["text"]]
    return pd.DataFrame({"tkey": rest["tkey"].astype("int64"), "same": same})


def _common(raw: DataFrame, shingle: int, texts: int = 20_000, most: int = 100_000) -> np.ndarray:
    """The shingles that several of a sample of different texts have, the most frequent last."""
    share = texts / max(raw.count(), 1)
    sample = raw if share >= 1 else raw.filter(F.pmod("tkey", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            keys = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["tkey", "token"])

    counted = sample.select("tkey", "text").mapInArrow(run, "tkey long, token long").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # As Arrow, tasks sort and cut them; rows would be sent by every partition, and be merged on the driver.
    found = counted.orderBy(F.desc("c"), "token").limit(most).select("token").toArrow()
    return found["token"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def prefix_links(texts: DataFrame, least: float, most: int = 32) -> DataFrame:
    """Links (a, b) that connect the fingerprints of all pairs of texts (tkey, fp, n, tokens) that can be similar.

    Beyond the first tokens of either text lie n - size(tokens) more, so the pair shares no more than what
    their prefixes share and the larger of these rests; `least` calls for least / (1 + least) of the sum of both
    sizes. A token of over `most` texts links each of them to the first, unweighed."""
    tokens = materialize(texts.select("tkey", "fp", "n", F.col("n") - F.size("tokens"), F.explode("tokens").alias("token")).toDF("tkey", "fp", "n", "rest", "token"), "dedup-tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("b")).filter("c > 1")
    shared = materialize(shared, "dedup-shared")
    star = tokens.join(shared.filter(F.col("c") > most), "token").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    star = materialize(star, "dedup-star")
    free_shuffles(texts.sparkSession)
    few = tokens.join(shared.filter(F.col("c") <= most).select("token"), "token").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("tkey", "fp", "n", "rest"))).alias("m"))
    later = F.transform("m", lambda x, i: F.struct(x.alias("x"), F.slice(F.col("m"), i + 2, F.size("m")).alias("ys")))
    pairs = few.select(F.explode(later).alias("p")).select("p.x", F.explode("p.ys").alias("y"))
    pairs = pairs.filter(F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - 1e-6)
    pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    near = pairs.filter(F.col("c") + F.greatest("x.rest", "y.rest") >= least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-6)
    return star.unionByName(near.filter("x.fp <> y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _distinguished(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows (tkey, other, ...) with another tkey for texts that share theirs with a different text."""
    own = F.when(F.col("clash"), F.xxhash64("tkey", "other")).otherwise(F.col("tkey"))
    return rows.join(by, "tkey", "left").withColumn("tkey", own).drop("clash")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, errors: int = 7, batch: int = 2048, batch_bytes: int = 32 << 20, key: Callable[[Column], Column] = text_hash) -> DataFrame:
    """docs with one row of each group of near copies.

    Candidates are components of two kinds of links: word-set fingerprints that differ in at most
    `errors` bits, by the trie self-join, and texts whose prefixes, the rarest of their shingles,
    meet often enough. The second kind leaves out no pair of a similarity of `least` or more, however long the
    passage that one has and the other has not. Within a component, the most central text leads (the fingerprint nearest to the
    majority of each bit, of equals the smallest doc_id): copies of one original differ less from
    it than from each other. Texts whose sets of `shingle` words have a Jaccard similarity of
    `least` or more with the leader's are its copies; of the rest the most central leads next, and
    so on. The `batch` most central texts (`batch_bytes` at most) are settled in one task, then the
    rest of the component is held against what they keep, in parts of as many, round by round until
    all are settled. Equal texts are one from the start, under their smallest doc_id. Rows of equal
    doc_id and text are one, too. Defined cases: null and empty texts are equal texts, so one row of them all stays; a null
    doc_id stands as the largest number, so another one leads; an empty table gives an empty result; all columns are handed through.

    Texts are told apart by `key`, 64 bits, and where two share it by 64 more of another seed: of 10^10
    texts a few pairs do, which are found by comparing the other hash within each key."""
    spark = docs.sparkSession
    bound_batches(spark)
    with scratch(spark) as keep:  # all tables but two go with the last step
        return _keep_one(docs, shingle, least, errors, batch, batch_bytes, key, keep)


def _keep_one(docs: DataFrame, shingle: int, least: float, errors: int, batch: int, batch_bytes: int, key: Callable[[Column], Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    did, said = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.coalesce(F.col("text"), F.lit(""))
    other = F.xxhash64(F.lit("talkledger"), said)
    clashes = docs.select(key(said).alias("tkey"), other.alias("other")).groupBy("tkey").agg((F.min("other") != F.max("other")).alias("clash")).filter("clash")
    clashes = keep(materialize(clashes, "dedup-clashes"))
    alike = not clashes.isEmpty()
    raw = docs.select(did.alias("did"), key(said).alias("tkey"), other.alias("other"), said.cast("binary").alias("text"))
    raw = (_distinguished(raw, clashes) if alike else raw).select("did", "tkey", "text")

    common = _common(raw, shingle)
    by_hash = np.argsort(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([word_fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column(2)]
            sizes = pa.array([len(x) for x in sets], pa.int32())
            tokens = pa.array([prefix(x, least, common, by_hash).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), sizes, tokens], names=["did", "tkey", "fp", "n", "tokens"])

    prints = materialize(raw.mapInArrow(run, "did long, tkey long, fp long, n int, tokens array<long>"), "dedup-prefixes")
    texts = materialize(prints.groupBy("tkey").agg(F.min("did").alias("did"), F.min("fp").alias("fp")), "dedup-texts")
    fps = materialize(texts.select("fp").distinct(), "dedup-prints")
    with scratch(spark) as keep_too:  # tokens and pairs are far more than what they link
        # One kind after the other: what each of them shuffles is there at a time.
        forest = materialize(link_forest(fps, fps.count(), errors), "dedup-forest")
        free_shuffles(spark)
        roots = keep_too(components(forest.unionByName(prefix_links(prints.dropDuplicates(["tkey"]), least)), "dedup"))
    free_shuffles(spark)
    texts = texts.join(roots, texts["fp"] == roots["node"], "left").select("tkey", "did", F.col("fp").alias("print"), F.coalesce("root", "fp").alias("root"))
    texts = materialize(texts, "dedup-rooted")
    several = texts.groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("root")
    several = materialize(texts.join(several, "root", "left_semi"), "dedup-several")
    # The texts of groups only, each once. Rounds rewrite who is open, not the texts.
    open_ = raw.join(several, ["did", "tkey"]).select("root", "tkey", "did", "print", "text").dropDuplicates(["tkey"])
    texts_of = materialize(open_.select("*", F.octet_length("text").cast("long").alias("size")), "dedup-open")
    held, open_ = texts_of.count(), texts_of.drop("text")
    copies = None
    bit = lambda i: F.shiftrightunsigned(F.col("print"), i).bitwiseAND(F.lit(1).cast("long"))
    sums = open_.groupBy("root").agg(F.count(F.lit(1)).alias("c"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(BITS)])
    middle = F.lit(0).cast("long")
    for i in range(BITS):
        middle = middle.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("c"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    middles = materialize(sums.select("root", middle.alias("middle")), "dedup-middles")
    central = Window.partitionBy("root").orderBy("away", "did", "tkey")
    away = F.bit_count(F.col("print").bitwiseXOR(F.col("middle")))
    while not open_.isEmpty():
        slim = open_.join(middles, "root").withColumn("away", away)
        first = slim.withColumn("rank", F.row_number().over(central)).filter(F.col("rank") <= batch)
        first = first.withColumn("held", F.sum("size").over(Window.partitionBy("root").orderBy("rank"))).filter((F.col("rank") == 1) | (F.col("held") <= batch_bytes))
        first = materialize(first.select("tkey", "rank"), "dedup-first")
        settled = texts_of.join(first, "tkey").select("root", "tkey", "rank", "text").groupBy("root").applyInPandas(lambda f: _greedy(f, shingle, least), "tkey long, kept boolean")
        settled = materialize(settled, "dedup-settled")
        found = settled.filter("not kept").select("tkey")
        copies = found if copies is None else copies.unionByName(found)
        open_ = materialize(open_.join(first, "tkey", "left_anti"), "dedup-open")
        if open_.isEmpty():
            break
        # The rest of large components, in parts, against what was kept of their batch.
        parts = open_.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(batch)), F.ceil(F.sum("size") / F.lit(batch_bytes))).cast("int").alias("parts"))
        parts = materialize(parts, "dedup-parts")
        rest = texts_of.join(open_.select("tkey"), "tkey").join(parts, "root").select(F.col("root").alias("r_root"), F.pmod(F.xxhash64("tkey"), F.col("parts")).cast("int").alias("r_part"), "tkey", "text")
        again = spark.read.schema(texts_of.schema).parquet(texts_of.path__)  # with columns of its own: both sides come of one table
        leads = again.select("root", "tkey", "text").join(settled.filter("kept").select("tkey"), "tkey").join(parts, "root")
        leads = leads.select(F.col("root").alias("l_root"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("l_part"), "text")
        judged = rest.groupBy("r_root", "r_part").cogroup(leads.groupBy("l_root", "l_part")).applyInPandas(lambda a, b: _held_against(a, b, shingle, least), "tkey long, same boolean")
        judged = materialize(judged, "dedup-judged")
        copies = copies.unionByName(judged.filter("same").select("tkey"))
        open_ = materialize(open_.join(judged.filter("not same").select("tkey"), "tkey"), "dedup-open")
        left = open_.count()
        if 2 * left <= held:  # all rewritten texts are no more than the first ones
            before = texts_of
            texts_of, held = materialize(texts_of.join(open_.select("tkey"), "tkey"), "dedup-texts-open"), left
            drop_folder(spark, before.path__)
        free_shuffles(spark)
    kept = texts.select("did", "tkey")
    if copies is not None:
        kept = kept.join(copies, "tkey", "left_anti")
    kept = keep(materialize(kept.select(F.col("did").alias("k_did"), F.col("tkey").alias("k_tkey")), "dedup-kept"))
    free_shuffles(spark)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), did.alias("did"), key(said).alias("tkey"), other.alias("other"))
    packed = _distinguished(packed, clashes) if alike else packed
    out = packed.join(kept, (F.col("did") == F.col("k_did")) & (F.col("tkey") == F.col("k_tkey"))).dropDuplicates(["did", "tkey"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
