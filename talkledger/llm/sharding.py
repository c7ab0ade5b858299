"""Sharding by balanced label propagation (operator 10).

Documents with equal texts are linked. A document's label is its shard; each round
moves linked documents towards the shard where most of their neighbours are, under
capacity quotas, so that few links are cut and no shard outgrows the others.

Since all documents of a group have the same neighbours, the state of the propagation
is the count of each (group, shard): at most `n_shards` rows for each group. Rounds
are joins and aggregates over these counts, so a group that holds a third of all
documents is a few rows there. Documents are dealt to the shards once, at the end.

Law `rows`: the sizes of any two shards differ by one row at most. Shard s has
N div n rows, and one more where s < N mod n. Linked documents come first in a shard's
slots; unlinked ones, and those that no quota had room for, fill up what is left.

Defined cases: a null text has size 8 and checksum 0 and is linked to empty and other
null texts; null ids and repeated rows are rows as any other; an empty table gives an
empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucketed_prefix, buckets_for, materialize

N_SHARDS = 24
ROUNDS = 4


def _quota_moves(moves: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """How many of each move's documents its target's quota lets in, the larger gains first.

    A target's room is shared among buckets of groups in proportion to their demand, so no
    task sees all moves to one shard."""
    b = F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")
    dealt = moves.withColumn("b", b)
    asked = dealt.groupBy("target", "b").agg(F.sum("cnt").alias("asked"))
    by_target = Window.partitionBy("target")
    has = F.element_at(F.array(*[F.lit(x) for x in room]).cast("array<bigint>"), F.col("target") + 1)
    # A floor of the share: the sum over buckets stays within the room.
    share = F.least(F.col("asked"), F.floor(F.col("asked") * (has / F.sum("asked").over(by_target))))
    quota = asked.withColumn("quota", share.cast("long")).drop("asked")
    first = Window.partitionBy("target", "b").orderBy(F.desc("gain"), "g", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("before", F.sum("cnt").over(first) - F.col("cnt")).join(quota, ["target", "b"])
    let_in = F.greatest(F.lit(0), F.least(F.col("cnt"), F.col("quota") - F.col("before")))
    return ranked.withColumn("moved", let_in.cast("long")).select("g", "shard", "target", "cnt", "moved")


def propagate(state: DataFrame, n_shards: int, capacity: int, rounds: int, buckets: int) -> DataFrame:
    """state: (g, shard, cnt) of groups with two or more documents. Returns the same after the rounds."""
    of_group = Window.partitionBy("g")  # at most n_shards rows
    spot = F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 20))
    for _ in range(rounds):
        held = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("c")).collect()}  # n_shards rows
        free = F.element_at(F.array(*[F.lit(max(0, capacity - held.get(s, 0))) for s in range(n_shards)]).cast("array<bigint>"), F.col("shard") + 1)
        # A group is drawn to where most of it can be: its members there and the room for more.
        ranked = (
            state.withColumn("n", F.sum("cnt").over(of_group))
            .withColumn("pull", F.least(F.col("n"), F.col("cnt") + free))
            .withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("pull"), F.desc("cnt"), spot, "shard")))
            .withColumn("homes", F.least(F.lit(n_shards), F.ceil(F.col("n") / F.lit(max(1, capacity)))).cast("int"))
            .withColumn("best", F.collect_list(F.struct("shard", "cnt")).over(of_group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        )
        target = F.get("best", F.pmod(F.col("rank") - 1, F.col("homes")))
        ranked = materialize(
            ranked.select("g", "shard", "cnt", "rank", "homes", target["shard"].alias("target"), (target["cnt"] - F.col("cnt")).alias("gain")), "shard-wants"
        )
        stays = ranked.filter("rank <= homes")
        moves = ranked.filter("rank > homes")
        # What leaves a shard makes room there too: half of it is counted, so that no round overfills.
        leaving = {r["shard"]: r["c"] for r in moves.groupBy("shard").agg(F.sum("cnt").alias("c")).collect()}
        room = [max(0, capacity - held.get(s, 0) + leaving.get(s, 0) // 2) for s in range(n_shards)]
        let_in = _quota_moves(moves, room, buckets)
        parts = (
            stays.select("g", "shard", "cnt")
            .unionByName(let_in.select("g", F.col("target").alias("shard"), F.col("moved").alias("cnt")))
            .unionByName(let_in.select("g", "shard", (F.col("cnt") - F.col("moved")).alias("cnt")))
        )
        state = materialize(parts.filter("cnt > 0").groupBy("g", "shard").agg(F.sum("cnt").alias("cnt")), "shard-state")
    return state


def _trim(state: DataFrame, full: list[int], held: list[int], buckets: int) -> DataFrame:
    """Send what exceeds a shard's size back to the pool, small parts of groups first."""
    excess = [max(0, h - f) for h, f in zip(held, full, strict=True)]
    if not any(excess):
        return state
    b = F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")
    dealt = state.withColumn("b", b)
    sums = dealt.groupBy("shard", "b").agg(F.sum("cnt").alias("c"))
    over = F.element_at(F.array(*[F.lit(x) for x in excess]).cast("array<bigint>"), F.col("shard") + 1)
    share = F.least(F.col("c"), F.ceil(F.col("c") * (over / F.sum("c").over(Window.partitionBy("shard")))))
    out = sums.withColumn("out", share.cast("long")).drop("c")
    order = Window.partitionBy("shard", "b").orderBy("cnt", "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("before", F.sum("cnt").over(order) - F.col("cnt")).join(out, ["shard", "b"])
    left = F.col("cnt") - F.greatest(F.lit(0), F.least(F.col("cnt"), F.col("out") - F.col("before")))
    return materialize(ranked.select("g", "shard", left.cast("long").alias("cnt")).filter("cnt > 0"), "shard-trim")


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("g")),
        "shard-base",
    )
    total = base.count()
    buckets = buckets_for(total)
    few = buckets_for(total, least=1)  # of (group, shard) counts: quotas are shared among these, so no more than needed
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    spread = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "g")
    base = base.withColumn("spread", spread).withColumn("salt", F.pmod("spread", F.lit(buckets)).cast("int"))

    start = base.groupBy("g", F.pmod("spread", F.lit(n_shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))
    linked = materialize(start.withColumn("n", F.sum("cnt").over(Window.partitionBy("g"))).filter("n > 1").drop("n"), "shard-start")
    state = propagate(linked, n_shards, total // n_shards, rounds, few)
    held = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("c")).collect()}
    state = _trim(state, sizes, [held.get(s, 0) for s in range(n_shards)], few)
    held = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("c")).collect()}
    held = [held.get(s, 0) for s in range(n_shards)]

    # Each group's places: which of its members go to which shard, from which slot on.
    places = bucketed_prefix(state, ["shard"], [F.col("g")], F.col("cnt"), "slot", F.xxhash64("g"), buckets)
    lo = F.sum("cnt").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cnt")
    places = places.withColumn("lo", lo).groupBy("g").agg(F.collect_list(F.struct("lo", "cnt", "shard", "slot")).alias("places"))
    # A member's number in its group: that in its (group, salt) and the salt's offset. No join or window has a larger key.
    salted = base.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("c"))
    by_salt = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    salted = salted.withColumn("offset", F.sum("c").over(by_salt) - F.col("c")).join(places, "g").select("g", "salt", "offset", "places")
    number = F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc_id")) - 1
    placed = base.withColumn("k", number).join(salted, ["g", "salt"], "left").withColumn("k", F.col("k") + F.col("offset"))
    place = F.get(F.filter("places", lambda p: (p["lo"] <= F.col("k")) & (F.col("k") < p["lo"] + p["cnt"])), F.lit(0))
    placed = materialize(
        placed.withColumn("place", place).select(
            "doc_id", "size", "text_crc32", "g", "spread", F.col("place.shard").alias("shard"), (F.col("place.slot") + F.col("k") - F.col("place.lo")).alias("slot")
        ),
        "shard-placed",
    )
    # The others fill the holes, shard after shard.
    holes, seen = [], 0
    for s in range(n_shards):
        holes.append((s, seen, held[s]))
        seen += sizes[s] - held[s]
    pool = bucketed_prefix(placed.filter("shard is null").drop("shard", "slot"), [], [F.col("doc_id"), F.col("g")], F.lit(1), "r", F.col("spread"), buckets)
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, first, used in holes:
        shard = F.when(F.col("r") >= first, F.lit(s)).otherwise(shard) if sizes[s] > used else shard
        slot = F.when(F.col("r") >= first, F.col("r") - first + used).otherwise(slot) if sizes[s] > used else slot
    pool = pool.withColumn("shard", shard).withColumn("slot", slot)
    result = placed.filter("shard is not null").unionByName(pool.select(*placed.columns))
    return result.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
