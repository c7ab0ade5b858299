"""SentencePiece encoding and decoding by suffix-array matching (operator 7).

A batch's texts are normalised and cut where no piece can cross (before a run of word
marks); the different parts of a batch are concatenated into one text. Its suffixes are
sorted as far as the longest piece reaches; every piece of the vocabulary is searched for
in them by binary search, which gives its range of occurrences. The edges (position,
length, piece) of all pieces, sorted by position, are then relaxed for all parts at once:
for a unigram model along the best path from left to right, for a BPE model by joining,
in each part, the adjacent pair whose edge has the best score (the leftmost of equals),
until none has an edge. That is done in rounds, one join in each part; a part of over `ROUNDS`
characters takes its joins from a heap, as rounds would take the square of its length, and its
edges from an index in stretches, so that no sort holds all of it. What no piece covers is spelt in byte pieces, or is unknown.

The ids are those of the public SentencePiece library. Decoding joins the pieces, bytes
as UTF-8. The model file is a parameter; it is read on the driver and its table of pieces,
which is of fixed size, goes to the tasks.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids;
characters outside the vocabulary go through byte pieces and come back as they were;
lone surrogates can't occur in a Spark string; repeated rows are rows as any other; an
empty table gives an empty result; other columns are handed through by `encode`.
"""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Types of pieces and models in the public file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PART_CHARS = 120_000  # of new parts that are indexed at once
ROUNDS = 48  # characters of a part up to which joins go in rounds
MEMO_BYTES = 48 << 20  # of parts that a task keeps from one batch to the next


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protocol buffers' wire format."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 0x80:
                return n, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    trim_spaces: bool = True

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER_DEFINED)}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else -1
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        if any(self.types[i] == USER_DEFINED for i in self.ids.values()):
            raise ValueError("user-defined pieces aren't supported")
        self.type_array = np.array(self.types, np.int64)
        self.plain = ["" if t == CONTROL else p for p, t in zip(self.pieces, self.types)]  # noqa: B905
        # The pieces' characters as rows, padded by 0, which no piece has.
        self.piece_ids = np.array([i for p, i in self.ids.items() if "\0" not in p], np.int64)
        self.piece_sizes = np.array([len(self.pieces[i]) for i in self.piece_ids], np.int64)
        self.piece_codes = np.zeros((len(self.piece_ids), self.longest), np.uint32)
        for row, i in enumerate(self.piece_ids):
            self.piece_codes[row, : self.piece_sizes[row]] = [ord(c) for c in self.pieces[i]]
        # A part may start at a mark unless some piece has one after another character.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)


def load_model(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    m = {"pieces": [], "scores": [], "types": []}
    more: dict = {}
    for n, v in _fields(data):
        if n == 1:
            p = dict(_fields(v))
            m["pieces"].append(p[1].decode())
            m["scores"].append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            m["types"].append(p.get(3, NORMAL))
        elif n == 2:
            more["kind"] = dict(_fields(v)).get(3, UNIGRAM)
        elif n == 3:
            spec = dict(_fields(v))
            if spec.get(2):
                raise ValueError("only models that keep characters as they are are supported")
            more |= {"dummy_prefix": bool(spec.get(3, 1)), "trim_spaces": bool(spec.get(4, 1))}
    return Model(**m, **more)


def normalise(model: Model, text: str) -> str:
    if model.trim_spaces:
        text = " ".join(x for x in text.split(" ") if x)
    if not text:
        return ""
    return ((" " if model.dummy_prefix else "") + text).replace(" ", MARK)


def parts_of(model: Model, line: str) -> list[str]:
    """Cut before each run of marks, where no piece reaches across."""
    if not model.cuts or not line:
        return [line] if line else []
    words = line.split(MARK)
    parts, marks = [], 0
    if words[0]:
        parts.append(words[0])
    for w in words[1:]:
        marks += 1
        if w:
            parts.append(MARK * marks + w)
            marks = 0
    if marks:
        parts.append(MARK * marks)
    return parts


class Index:
    """The edges of every piece in a concatenated text, by position."""

    def __init__(self, model: Model, parts: list[str]) -> None:
        self.text = "\0".join(parts) + "\0"
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n, reach = len(codes), model.longest
        # Characters by rank, so that suffixes are rows of small numbers; 0 is the gap between parts.
        alphabet = np.unique(codes)
        rank = np.searchsorted(alphabet, codes).astype(np.int64)
        width = int(len(alphabet) + 1).bit_length()
        per_word = max(1, 62 // width)
        padded = np.concatenate([rank, np.zeros(reach + per_word, np.int64)])
        words = -(-reach // per_word)
        packed = []
        for w in range(words):
            k = np.zeros(n, np.int64)
            for j in range(per_word):
                k = k << width | padded[w * per_word + j : w * per_word + j + n]
            packed.append(k)
        order = np.lexsort(packed[::-1])
        self.order = order
        keys = [k[order] for k in packed]
        # Each piece whose characters all occur: its first and last possible suffix in the sorted order.
        place = np.minimum(np.searchsorted(alphabet, model.piece_codes), len(alphabet) - 1)
        inside = np.arange(reach) < model.piece_sizes[:, None]
        occurs = ((alphabet[place] == model.piece_codes) | ~inside).all(axis=1)
        place, inside = place[occurs].astype(np.int64), inside[occurs]
        ids, sizes = model.piece_ids[occurs], model.piece_sizes[occurs]
        low, high, full = [], [], (1 << width) - 1
        for w in range(words):
            a, b = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for j in range(w * per_word, (w + 1) * per_word):
                held = inside[:, j] if j < reach else np.zeros(len(ids), bool)
                at = place[:, j] if j < reach else a
                a, b = a << width | np.where(held, at, 0), b << width | np.where(held, at, full)
            low.append(a)
            high.append(b)
        first = self._search(keys, low, "left")
        last = self._search(keys, high, "right")
        counts = last - first
        total = int(counts.sum())
        which = np.repeat(np.arange(len(ids)), counts)
        at = order[np.repeat(first, counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)] if total else np.zeros(0, np.int64)
        size = sizes[which]
        by = np.argsort(at * (reach + 1) + size, kind="stable")
        self.reach = reach
        self.edge = (at * (reach + 1) + size)[by]  # position and length, sorted
        self.piece = ids[which][by]

    def bare(self) -> Index:
        """Only what find needs."""
        del self.text, self.order
        return self

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], side: str) -> np.ndarray:
        """Where each wanted row of words stands among the sorted rows: a binary search for all pieces at once."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (active := lo < hi).any():
            mid = np.where(active, (lo + hi) // 2, 0)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, w in zip(keys, wanted):  # noqa: B905
                v = k[mid]
                less |= same & (v < w)
                same &= v == w
            down = less | same if side == "right" else less
            lo, hi = np.where(active & down, mid + 1, lo), np.where(active & ~down, mid, hi)
        return lo

    def find(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The piece from each position over each length, or -1."""
        if not len(self.edge):
            return np.full(len(at), -1, np.int64)
        want = at * (self.reach + 1) + size
        k = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
        return np.where((size <= self.reach) & (self.edge[k] == want), self.piece[k], -1)


def _spell(model: Model, chars: str) -> list[int]:
    if model.bytes:
        return [model.bytes[b] for b in chars.encode("utf-8")]
    return [model.unknown]


def _join_short(model: Model, index: Index, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the symbols of parts, after all joins: one join in each part a round."""
    part = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(part)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    length = np.ones(len(at), np.int64)
    scores = np.array(model.scores)
    done_at, done_len = [], []
    # The score of each adjacent pair's edge; a row's last symbol in its part has none.
    pair = np.full(len(at), -np.inf)
    if len(at) > 1:
        near = np.flatnonzero(part[1:] == part[:-1])
        piece = index.find(at[near], length[near] + length[near + 1])
        pair[near] = np.where(piece >= 0, scores[piece], -np.inf)
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        best = np.maximum.reduceat(pair, first)
        counts = np.diff(np.append(first, len(at)))
        live = np.repeat(best > -np.inf, counts)
        done_at.append(at[~live])
        done_len.append(length[~live])
        if not live.any():
            break
        best = np.repeat(best, counts)[live]
        at, length, part, pair = at[live], length[live], part[live], pair[live]
        hit = np.flatnonzero(pair == best)
        hit = hit[np.concatenate([[True], part[hit][1:] != part[hit][:-1]])]  # the leftmost of each part
        length[hit] += length[hit + 1]
        keep = np.ones(len(at), bool)
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        at, length, part, pair = at[keep], length[keep], part[keep], pair[keep]
        hit = moved[hit]
        beside = np.zeros(len(at), bool)
        beside[hit] = beside[hit[hit > 0] - 1] = True
        redo = np.flatnonzero(beside)
        pair[redo] = -np.inf
        redo = redo[redo < len(at) - 1]
        redo = redo[part[redo] == part[redo + 1]]
        piece = index.find(at[redo], length[redo] + length[redo + 1])
        pair[redo] = np.where(piece >= 0, scores[piece], -np.inf)
    at, length = np.concatenate(done_at or [at]), np.concatenate(done_len or [length])
    by = np.argsort(at, kind="stable")
    return at[by], length[by]


class Stretches:
    """The edges of one long part, from indexes of stretches that overlap by what a piece can reach."""

    def __init__(self, model: Model, text: str, stretch: int = PART_CHARS) -> None:
        self.stretch, self.reach = stretch, model.longest
        self.indexes = [Index(model, [text[i : i + stretch + model.longest - 1]]).bare() for i in range(0, len(text), stretch)]

    def pairs(self, n: int) -> np.ndarray:
        """The piece over each two adjacent characters, or -1."""
        at = [np.arange(min(self.stretch, n - k * self.stretch)) for k in range(len(self.indexes))]
        return np.concatenate([x.find(a, np.full(len(a), 2)) for x, a in zip(self.indexes, at)])  # noqa: B905

    def find(self, at: int, size: int) -> int:
        if size > self.reach:
            return -1
        index = self.indexes[at // self.stretch]
        want = at % self.stretch * (self.reach + 1) + size
        k = bisect_left(index.edge, want)
        return int(index.piece[k]) if k < len(index.edge) and index.edge[k] == want else -1


def _join_long(model: Model, text: str) -> list[int]:
    """The ids of one long part: the same joins of the same edges, from a heap."""
    n = len(text)
    edges, scores = Stretches(model, text), model.scores
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(-scores[p], i, i + 1, i + 2) for i, p in enumerate(edges.pairs(n)[: n - 1].tolist()) if p >= 0]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (piece := edges.find(i, ends[j] - i)) >= 0:
            heapq.heappush(heap, (-scores[piece], i, ends[i], ends[j]))

    alive = bytearray(b"\1") * n
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if not alive[i] or ends[i] != middle or middle >= n or not alive[middle] or ends[middle] != end:
            continue
        alive[middle], ends[i], after[i] = 0, end, after[middle]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        piece = edges.find(i, ends[i] - i)
        out.extend([piece] if piece >= 0 else _spell(model, text[i : ends[i]]))
        i = after[i]
    return out


def _best_paths(model: Model, index: Index, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the pieces on each part's best path: positions are relaxed from left to right, all parts at once."""
    n = int((starts + sizes).max(initial=0)) + 1
    scores = np.array(model.scores)
    lowest = min((model.scores[i] for i in model.ids.values()), default=0.0) - 10.0  # of an unknown character
    best, back = np.full(n + index.reach + 1, -np.inf), np.zeros(n + index.reach + 1, np.int64)
    best[starts] = 0.0
    for step in range(int(sizes.max(initial=0))):
        at = starts[sizes > step] + step
        room = sizes[sizes > step] - step
        for size in range(1, index.reach + 1):
            ok = room >= size
            if not ok.any():
                break
            a = at[ok]
            piece = index.find(a, np.full(len(a), size))
            gain = np.where(piece >= 0, scores[piece], lowest if size == 1 else -np.inf)
            better = best[a] + gain > best[a + size]
            best[a[better] + size], back[a[better] + size] = (best[a] + gain)[better], size
    ends, found_at, found_len = starts + sizes, [], []
    while len(ends):
        size = back[ends]
        found_at.append(ends - size)
        found_len.append(size)
        ends, starts = ends - size, starts
        more = ends > starts
        ends, starts = ends[more], starts[more]
    at, length = np.concatenate(found_at or [starts]), np.concatenate(found_len or [starts])
    by = np.argsort(at, kind="stable")
    return at[by], length[by]


def encode_parts(model: Model, parts: list[str]) -> list[np.ndarray]:
    """The ids of each of the different parts."""
    found: list[np.ndarray | None] = [None] * len(parts)
    short = [i for i, p in enumerate(parts) if len(p) <= ROUNDS or model.kind != BPE]
    if short:
        index = Index(model, [parts[i] for i in short])
        sizes = np.array([len(parts[i]) for i in short], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        at, length = (_join_short if model.kind == BPE else _best_paths)(model, index, starts, sizes)
        piece = index.find(at, length)
        cut = np.searchsorted(at, starts)
        bounds = np.append(cut[1:], len(at))
        spelt = np.add.reduceat(piece < 0, cut) > 0
        narrow = piece.astype(np.int32)
        for i, a, b, odd in zip(short, cut.tolist(), bounds.tolist(), spelt.tolist()):  # noqa: B905
            if odd:
                ids = [x for p, s, n in zip(piece[a:b], at[a:b], length[a:b]) for x in ([p] if p >= 0 else _spell(model, index.text[s : s + n]))]  # noqa: B905
                found[i] = np.array(ids, np.int32)
            else:
                found[i] = narrow[a:b]
    for i, p in enumerate(parts):
        if found[i] is None:
            found[i] = np.array(_join_long(model, p), np.int32)
    return found


class Memo:
    """Parts that were encoded before: their numbers, and their ids one after the other."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)
        self.held = 0  # bytes, about

    def add(self, model: Model, parts: list[str]) -> None:
        found = encode_parts(model, parts)
        self.ids = np.concatenate([self.ids, *found])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(f) for f in found])])
        self.held += sum(160 + 2 * len(p) for p in parts) + 4 * sum(len(f) for f in found)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        start = self.bounds[numbers]
        sizes = self.bounds[numbers + 1] - start
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - sizes), sizes)] if len(ends) else np.zeros(0, np.int32)


def encode_batch(model: Model, texts: Iterable[str | None], memo: Memo) -> list[np.ndarray | None]:
    """The ids of each text. memo: what was encoded before; it is emptied between batches once it is large."""
    if memo.held > MEMO_BYTES:
        memo.__init__()
    cut: list[np.ndarray | None] = []
    new: list[str] = []
    numbers, size = memo.numbers, 0
    for t in texts:
        if t is None:
            cut.append(None)
            continue
        own = []
        for p in parts_of(model, normalise(model, t)):
            n = numbers.get(p)
            if n is None:
                n = numbers[p] = len(numbers)
                new.append(p)
                size += len(p)
                if size >= PART_CHARS:
                    memo.add(model, new)
                    new, size = [], 0
            own.append(n)
        cut.append(np.array(own, np.int32))
    if new:
        memo.add(model, new)
    return [None if own is None else memo.of(own) for own in cut]


def decode(model: Model, ids: np.ndarray) -> str:
    ids = np.asarray(ids, np.int64)
    kinds = model.type_array[ids]
    if not ((kinds == BYTE) | (kinds == UNKNOWN)).any():
        text = "".join(map(model.plain.__getitem__, ids.tolist()))
    else:
        out = bytearray()
        for i, kind in zip(ids.tolist(), kinds.tolist()):  # noqa: B905
            if kind == BYTE:
                out.append(int(model.pieces[i][3:5], 16))
            else:
                out += " ⁇ ".encode() if kind == UNKNOWN else model.plain[i].encode()
        text = out.decode("utf-8", "replace")
    text = text.replace(MARK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column ids (array of int), which docs must not have."""
    if ids in docs.columns:
        raise ValueError(f"there is a column {ids} already")
    bound_batches(docs.sparkSession, megabytes=8)
    model = load_model(model_path)
    names = [*docs.columns, ids]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            found = encode_batch(model, (t.as_py() for t in b.column(at)), memo)
            sizes = np.cumsum([0, *(0 if f is None else len(f) for f in found)])
            whole = np.concatenate([f for f in found if f is not None]) if any(f is not None for f in found) else np.zeros(0, np.int32)
            lists = pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), pa.array(whole, pa.int32())).cast(pa.list_(pa.int32()))
            if any(f is None for f in found):
                lists = pa.array([None if f is None else f for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_column(encoded: DataFrame, model_path: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of its ids."""
    model = load_model(model_path)
    names = [*encoded.columns, text]
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            texts = [decode(model, values[lo:hi]) if ok else None for lo, hi, ok in zip(bounds[:-1], bounds[1:], column.is_valid().to_pylist())]  # noqa: B905
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))


def report(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids decode to the text) of every row of docs (doc_id, text)."""
    encoded = encode(docs.select("doc_id", "text"), model_path)
    decoded = decode_column(encoded, model_path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
