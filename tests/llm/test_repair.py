"""Operator 12 against a shortest-path search over the grammar's automaton, which knows nothing of retained turns."""

import hashlib
import heapq
import random
import zlib
from itertools import groupby

import pytest

from talkledger.llm import repair as r

#: States of (s?(ua)+)?: start, after s, after u, after a; roles by initial.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, turns) by Dijkstra over (rows done, state)."""
    heap = [(0, "", 0, 0, ())]
    seen = set()
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, turns
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for x in "ua":
            if (state, x) in STEPS:
                heapq.heappush(heap, (cost + 2, audit + "I", at, STEPS[state, x], (*turns, (FULL[x], ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, turns))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in STEPS:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, STEPS[state, role[:1]], (*turns, (role, text))))
                for x in "ua":
                    if (state, x) in STEPS:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, STEPS[state, x], (*turns, (FULL[x], text))))


def faulty(rows):
    """(turn, role, text, fault) after sorting, the first fault of each."""
    out, seen = [], set()
    for turn, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def expected(rows):
    """The contract's row for the rows of one conversation before damage."""
    space = lambda x: " " if x is None else x
    after = []
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after = faulty(after)
    turns = [t for t, *_ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [sum(f == kind for *_, f in after) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
    cost, audit, kept = cheapest([(role, text, f) for _, role, text, f in after])
    said = "\n".join(f"{role}:{text}" for role, text in kept)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def some_rows(rng, conv):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut", "a b", " \t", "", None, "Fin. \n", "é"]
    return [(conv, rng.choice([i, i, i, None, i - 1, i + 2]), rng.choice(roles), rng.choice(texts)) for i in range(rng.randint(1, 9))]


def test_programme_equals_shortest_paths():
    rng = random.Random(7)
    for n in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "usher", "tool"]), f"t{i}", rng.choice(["", "", "", "truncated", "blank"])) for i in range(rng.randint(0, 14 if n % 10 else 90))]
        got = []
        p = r.Repair(lambda letter, turn, role, text: got.append((letter, role, text)))  # noqa: B023
        for role, text, fault in rows:
            p.turn(0, role, text, {"": 0, "blank": r.BLANK, "truncated": r.CUT}[fault])
        cost = p.end()
        assert (cost, "".join(x for x, *_ in got), tuple(x[1:] for x in got if x[0] != "D")) == cheapest(rows)


def test_long_conversation_stays_open_only_a_few_turns():
    rng, widest = random.Random(3), 0
    p = r.Repair(lambda *_: None)
    for i in range(20_000):
        p.turn(i, rng.choice(["user", "assistant"]), f"t{i}", rng.choice([0, 0, r.CUT, r.BLANK]))
        widest = max(widest, len(p.open))
    p.end()
    assert widest <= 256 and not p.open


def test_contract_on_random_conversations(spark):
    rng = random.Random(11)
    rows = [x for conv in [*range(250), None] for x in some_rows(rng, conv)]
    rows += rows[:40]  # repeated rows
    schema = "conv_id long, turn long, role string, text string, copies string, fault int"
    df = spark.createDataFrame([(*x, "clash", 9) for x in rows], schema).repartition(5)
    got = {row[0]: tuple(row)[1:] for row in r.report(df).collect()}
    key = lambda x: (x[0] is not None, x[0] or 0)
    want = {conv: expected(list(of)) for conv, of in groupby(sorted(rows, key=key), key=lambda x: x[0])}
    assert got == want


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(x) for x in df.select("conv_id", "turn", "role", "text").collect()]
    got = {row[0]: tuple(row)[1:] for row in r.report(df).collect()}
    assert got == {conv: expected(list(of)) for conv, of in groupby(sorted(rows, key=lambda x: x[0]), key=lambda x: x[0])}


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    got = r.report(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(x) for x in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], schema)
    assert r.report(empty).count() == 0 and r.repair(empty).count() == 0


def test_repaired_turns(spark):
    rows = [("c", 1, "user", "Hi."), ("c", 2, "user", "There."), ("c", 3, "assistant", "Yes."), ("c", 4, None, None), ("d", 1, "assistant", "So.")]
    got = r.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).orderBy("conv_id", "place").collect()
    assert [tuple(x)[2:] for x in got if x["conv_id"] == "c"] == [
        (1, "user", "Hi.", "keep"), (None, "assistant", "", "insert"), (2, "user", "There.", "keep"), (3, "assistant", "Yes.", "keep"),
    ]
    assert [x["edit"] for x in got if x["conv_id"] == "d"] == ["insert", "keep"]


@pytest.mark.parametrize("y", ["", "s", "u", "a"])
def test_a_state_can_imitate_another_for_what_is_said(y):
    """Every short continuation costs at most that much more."""
    rng = random.Random(5)
    for x in ("", "s", "u", "a"):
        if x == y:
            continue
        for _ in range(60):
            rows = [(rng.choice(["user", "assistant", "system"]), "t", rng.choice([0, r.CUT])) for _ in range(rng.randint(0, 6))]
            costs = []
            for state in (x, y):
                p = r.Repair(lambda *_: None)
                p.states = {state: (0, "")}
                for role, text, fault in rows:
                    p.turn(0, role, text, fault)
                costs.append(min(c + 2 * r.INSERTS[q, ""] for q, (c, _) in p.states.items()))
            assert costs[1] <= costs[0] + r.IMITATE[y, x]
