"""Repair of conversation structure by a dynamic programme over retained turns (operator 12).

A conversation is whole if its turns are an optional system turn and then user and assistant in turn:
`(s?(ua)+)?` in role initials. Edits keep a turn, rerole it, delete it, or insert an empty one. The
programme chooses which turns are retained, with which role. Between two retained turns all others are deleted, and
their pair of roles determines what has to be inserted, so a retained turn of role r at place j costs

    price(j, r) + min over p, i < j of best(i, p) + DELETE * (j - i - 1) + INSERT * inserts(p, r)

Deletions are prefix sums, so for every role p only the cheapest best(i, p) - DELETE * i has to be known: a running
minimum for each of four states (nothing retained yet, or the last retained turn's initial). With equal costs
the audit, the string of edits, decides: two audits up to the same turn differ by more than a tail of
inserts, so the smaller stays smaller whatever follows.

A conversation is read turn by turn. A state that another could imitate for less is dropped, and edits that the
audits of all states begin with are final: their turns are handed on. Memory holds the turns
that are still open, a few, however long the conversation is. What rows say on their own (damage, blank, truncated) is
computed where they are read; then rows are dealt by conversation and sorted, on disk if need be.
The hash of a repaired conversation is one function of all its turns in order, so a conversation is
read by one task, as a stream.

Defined cases: a null role or text, and a null conv_id or turn in the damaged key, is one space; a null conv_id is a
conversation of its own; turns of equal number follow in the order of role, then text; rows equal in all
four columns are duplicates; a role that is empty or begins with another letter can't be kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bound_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: How many turns have to be inserted between a turn of the first role (or the start) and one of the second (or the end).
INSERTS = {
    ("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("", ""): 0,
    ("s", "u"): 0, ("s", "a"): 1, ("s", ""): 2,
    ("u", "u"): 1, ("u", "a"): 0, ("u", ""): 1,
    ("a", "u"): 0, ("a", "a"): 1, ("a", ""): 0,
}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"


def _imitation(y: str, x: str) -> int:
    """The most that it can cost more to go on from state y as a continuation from state x does."""
    gap = lambda p, r: INSERT * INSERTS[p, r]
    more = [gap(y, r) - gap(x, r) for r in ("u", "a", "")]
    if x == "" and y != "":  # a system turn that x keeps goes
        more += [DELETE + gap(y, r) - gap("s", r) for r in ("u", "a", "")]
    return max(more)


IMITATE = {(y, x): _imitation(y, x) for y in ("", "s", "u", "a") for x in ("", "s", "u", "a") if x != y}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: every row as a fault of its own leaves it; copies is 0 for a dropped row, 2 for a repeated one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _own_fault(text: Column) -> Column:
    said = F.rtrim(text, F.lit(SPACES))
    return F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with their first fault, each conversation in order in one partition.

    Dropped rows stay without a text, so that their conversation is known."""
    here = F.col("copies") > 0
    rows = rows.select("conv_id", "turn", F.when(here, F.col("role")).alias("role"), F.when(here, F.col("text")).alias("text"), F.col("copies").cast("int").alias("copies"))
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    rows = rows.select("*", F.when(here, F.unhex(said)).alias("said"), F.when(here, _own_fault(F.col("text"))).alias("own"))
    rows = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy(F.asc_nulls_first("turn"))) > 1
    rows = rows.withColumn("fault", F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own")).cast("int"))
    return rows.select("conv_id", "turn", "role", "text", "copies", "fault").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


class Repair:
    """The programme for one conversation. `edit` gets each final edit: its letter, the turn's number, role and text."""

    def __init__(self, edit: Callable[[str, int | None, str, str], None]) -> None:
        self.edit = edit
        self.states = {"": (0, "")}  # last retained role: cost, audit behind what is final
        self.open: deque[tuple[int | None, str, str]] = deque()
        self.last = ""  # role of the last final turn
        self.look = 32

    def turn(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.open.append((turn, role, text))
        new = {p: (cost + DELETE, audit + "D") for p, (cost, audit) in self.states.items()}
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            options = [("u", "R", REROLE + extra), ("a", "R", REROLE + extra)]
            if role[:1] in ("s", "u", "a"):
                options.append((role[0], "K", extra))
            for r, letter, price in options:
                for p, (cost, audit) in self.states.items():
                    gap = INSERTS.get((p, r))
                    if gap is not None:
                        found = (cost + INSERT * gap + price, audit + "I" * gap + letter)
                        if r not in new or found < new[r]:
                            new[r] = found
        if len(new) > 1:
            new = {x: v for x, v in new.items() if not any(y != x and v[0] > cost + IMITATE[y, x] for y, (cost, _) in new.items())}
        self.states = new
        if len(self.open) >= self.look:
            self._settle(os.path.commonprefix([audit for _, audit in new.values()]))
            self.look = max(32, 2 * len(self.open))

    def end(self) -> int:
        """The cost; all edits are final then."""
        cost, audit = min((cost + INSERT * INSERTS[p, ""], audit + "I" * INSERTS[p, ""]) for p, (cost, audit) in self.states.items())
        self.states = {"": (cost, audit)}
        self._settle(audit)
        return cost

    def _settle(self, audit: str) -> None:
        self.states = {p: (cost, rest[len(audit) :]) for p, (cost, rest) in self.states.items()}
        for letter in audit:
            due = "assistant" if self.last == "u" else "user"
            turn, role, text = self.open.popleft() if letter != "I" else (None, "", "")
            role = role if letter in "KD" else due
            if letter != "D":
                self.last = role[0]
            self.edit(letter, turn, role, text)


class Digest:
    """Counts of one conversation and the hash of its repair, built as its turns pass."""

    def __init__(self) -> None:
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.first = self.last_turn = None
        self.initial: str | None = None
        self.some = False
        self.repair = Repair(self._edit)

    def _edit(self, letter: str, turn: int | None, role: str, text: str) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.hash.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode())
            self.some = True

    def turn(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.last_turn:
            self.first = turn if self.first is None else self.first
            self.last_turn = turn
            self.distinct += 1
        self.repair.turn(turn, role, text, fault)

    def row(self) -> tuple:
        cost = self.repair.end()
        gaps = self.last_turn - self.first + 1 - self.distinct if self.distinct else 0
        return gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


class Turns:
    """The repaired turns of one conversation, handed out as they become final."""

    def __init__(self) -> None:
        self.place = 0
        self.final: list[tuple] = []
        self.repair = Repair(self._edit)

    def _edit(self, letter: str, turn: int | None, role: str, text: str) -> None:
        if letter != "D":
            self.final.append((self.place, turn, role, text, {"K": "keep", "R": "rerole", "I": "insert"}[letter]))
            self.place += 1

    def turn(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.repair.turn(turn, role, text, fault)


def _stream(batches: Iterator[pa.RecordBatch], new: Callable) -> Iterator[tuple]:  # noqa: ANN001
    """(conv_id, reader, whether the conversation ends) after each batch's share of a conversation."""
    conv, reader = None, None
    for batch in batches:
        for conv_id, turn, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
            if reader is None or conv_id != conv:
                if reader is not None:
                    yield conv, reader, True
                conv, reader = conv_id, new()
            for copy in range(copies):
                reader.turn(turn, role, text, DUPLICATE if copy and fault != BLANK else fault)
        if reader is not None:
            yield conv, reader, False
    if reader is not None:
        yield conv, reader, True


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(rows: DataFrame, rest: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(rest).fields])
    return out, to_arrow_schema(out)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit: the turns of every conversation after its cheapest repair.

    rows: conv_id, turn, role, text and, if some stand for none or several, copies."""
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    out, schema = _schema(rows, "place long, turn long, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns, over in _stream(batches, Turns):
            if over:
                turns.repair.end()
            if turns.final:
                yield _batch([(conv, *t) for t in turns.final], schema)
                turns.final.clear()

    bound_batches(rows.sparkSession)
    return ordered(rows).mapInArrow(run, out)


def digest(rows: DataFrame, per_batch: int = 1000) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation."""
    out, schema = _schema(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for conv, counts, over in _stream(batches, Digest):
            if over:
                done.append((conv, *counts.row()))
                if len(done) >= per_batch:
                    yield _batch(done, schema)
                    done = []
        if done:
            yield _batch(done, schema)

    bound_batches(rows.sparkSession)
    return ordered(rows).mapInArrow(run, out)


def report(conversations: DataFrame) -> DataFrame:
    return digest(damage(conversations))
