"""Language identification by a bidirectional gated recurrent network over bytes (operator 13).

One gated layer reads the bytes of a text forwards, one backwards; at every byte both states give, through a softmax,
the probabilities of the languages, so every position has a label. A text's probabilities are the means over its bytes.
The weights are fitted in numpy by backpropagation through time, with Adam, on a bounded sample of
labelled texts: at most `per_language` different texts of each language, of each `crops` windows and as many shorter pieces.

Texts are read whole, in windows of CORE bytes with CONTEXT bytes more on either side, from which the states start;
the network is fitted on windows of the same form. Windows of all texts of a batch are read together, a step of all of them at
a time. What tasks hold is bounded by batches of rows and bytes and by blocks of windows, however long a text is.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing could be
learned; a null doc_id counts as an empty one for `held_out`; rows that are equal get equal results;
rows without a language teach nothing; columns besides doc_id, text and lang are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches

CORE, CONTEXT = 112, 8
STEPS = CORE + 2 * CONTEXT
OUTSIDE = 256  # the symbol beyond the ends of a text
HIDDEN = 8
BLOCK = 1024  # windows that are read together
PER_LANGUAGE, CROPS = 400, 3
EPOCHS, BATCH, RATE = 6, 256, 0.03
UNKNOWN = "und"
_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_SPANS = "doc_id long, start long, end long, lang string"


@dataclass
class Network:
    """Weights of both directions, index 0 forwards and 1 backwards. Gates stand as update, reset, candidate."""

    langs: list[str]
    table: np.ndarray  # 2, 257, 3H: what a byte adds to the gates
    inner: np.ndarray  # 2, H, 3H
    bias: np.ndarray  # 2, H: of the candidate's share of the state
    out: np.ndarray  # 2H, languages
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.out_bias]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 13) -> Network:
    rng = np.random.default_rng(seed)
    near = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    n = len(langs)
    return Network(langs, near(2, 257, 3 * hidden, s=0.3), near(2, hidden, 3 * hidden, s=0.3), np.zeros((2, hidden), np.float32), near(2 * hidden, n, s=0.3), np.zeros(n, np.float32))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array of symbols, with what is outside between them; where each window starts; whose it is."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // CORE)
    rooms = counts * CORE + 2 * CONTEXT
    at = np.cumsum(rooms) - rooms
    flat = np.full(int(rooms.sum()), OUTSIDE, np.int16)
    for t, a in zip(texts, at, strict=True):
        flat[a + CONTEXT : a + CONTEXT + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    return flat, at[owner] + CORE * (np.arange(len(owner)) - first[owner]), owner


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Reader:
    """Reads windows, gate by gate in arrays of their own.

    A gate's sigmoid is half of one plus a hyperbolic tangent of half its argument; both halves are folded into weights."""

    def __init__(self, net: Network) -> None:
        h = net.inner.shape[1]
        halves = np.array([0.5, 0.5, 1.0], np.float32)[:, None, None]
        split = lambda w: np.ascontiguousarray(w.reshape(-1, 3, h).transpose(1, 0, 2))
        self.h, self.n_langs = h, net.out.shape[1]
        self.table = [split(w) * halves for w in net.table]
        self.inner = [split(w) * np.float32(0.5) for w in net.inner]  # of the candidate's share too, which the reset gate weighs
        self.bias = net.bias * np.float32(0.5)
        self.out, self.out_bias = [np.ascontiguousarray(w.T) for w in net.out.reshape(2, h, -1)], net.out_bias

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """Probabilities at each core position: symbols is STEPS x windows, the result languages x CORE x windows."""
        h, n = self.h, symbols.shape[1]
        symbols = symbols.astype(np.intp)
        scores = np.zeros((self.n_langs, CORE * n), np.float32)
        states = np.empty((CORE, n, h), np.float32)
        x, y, aside = (np.empty(shape, np.float32) for shape in ((3, n, h), (3, n, h), (n, h)))
        for d in (0, 1):
            state = np.zeros((n, h), np.float32)
            for t in range(CORE + CONTEXT) if d == 0 else range(STEPS - 1, CONTEXT - 1, -1):
                for gate in range(3):
                    np.take(self.table[d][gate], symbols[t], axis=0, out=x[gate], mode="clip")
                np.matmul(state, self.inner[d], out=y)
                gates = y[:2]
                gates += x[:2]
                np.tanh(gates, out=gates)
                update, reset, share, new = y[0], y[1], y[2], x[2]
                share += self.bias[d]
                reset *= share
                new += share
                new += reset
                np.tanh(new, out=new)
                np.subtract(state, new, out=aside)
                aside *= 0.5
                update *= aside
                new += aside
                state = states[t - CONTEXT] if CONTEXT <= t < CONTEXT + CORE else np.empty((n, h), np.float32)
                np.add(update, new, out=state)
            scores += self.out[d] @ states.reshape(-1, h).T
        scores += self.out_bias[:, None]
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        return scores.reshape(self.n_langs, CORE, n)

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner of each window, symbols of the core, probabilities) of some windows after the other."""
        flat, starts, owner = windows_of(texts)
        steps = np.arange(STEPS)[:, None]
        for at in range(0, len(starts), BLOCK):
            symbols = flat[steps + starts[at : at + BLOCK]]
            yield owner[at : at + BLOCK], symbols[CONTEXT : CONTEXT + CORE], self.read(symbols)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean probabilities of each text; zeros for an empty one."""
        sums = np.zeros((len(texts), self.n_langs))
        for owner, symbols, found in self.blocks(texts):
            found *= symbols != OUTSIDE
            np.add.at(sums, owner, found.sum(axis=1, dtype=np.float64).T)
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def gradients(net: Network, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy over the core positions within the texts, and its gradients by backpropagation through time."""
    h, n = net.inner.shape[1], symbols.shape[1]
    inside = symbols[CONTEXT : CONTEXT + CORE] != OUTSIDE
    total = max(1, int(inside.sum()))
    kept: list[list[tuple]] = [[], []]
    states = np.zeros((CORE, n, 2 * h), net.inner.dtype)
    for d in (0, 1):
        state = np.zeros((n, h), net.inner.dtype)
        for t in range(CORE + CONTEXT) if d == 0 else range(STEPS - 1, CONTEXT - 1, -1):
            x, y = net.table[d][symbols[t]], state @ net.inner[d]
            gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + y[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            share = y[:, 2 * h :] + net.bias[d]
            new = np.tanh(x[:, 2 * h :] + r * share)
            kept[d].append((t, state, z, r, share, new))
            state = new + z * (state - new)
            if CONTEXT <= t < CONTEXT + CORE:
                states[t - CONTEXT, :, d * h : (d + 1) * h] = state
    found = _softmax(states @ net.out + net.out_bias)
    right = np.take_along_axis(found, np.broadcast_to(labels[None, :, None], (CORE, n, 1)), axis=2)[:, :, 0]
    loss = float(-(np.log(right + 1e-12) * inside).sum() / total)
    back = found
    back[:, np.arange(n), labels] -= 1
    back *= inside[:, :, None] / total
    grads = [np.zeros_like(p) for p in net.params()]
    g_table, g_inner, g_bias, g_out, g_out_bias = grads
    g_out += states.reshape(-1, 2 * h).T @ back.reshape(-1, back.shape[2])
    g_out_bias += back.sum(axis=(0, 1))
    to_states = back @ net.out.T
    for d in (0, 1):
        flow = np.zeros((n, h), net.inner.dtype)
        for t, state, z, r, share, new in reversed(kept[d]):
            if CONTEXT <= t < CONTEXT + CORE:
                flow = flow + to_states[t - CONTEXT, :, d * h : (d + 1) * h]
            to_new = flow * (1 - z) * (1 - new * new)
            to_gates = np.concatenate([flow * (state - new) * z * (1 - z), to_new * share * r * (1 - r), to_new], axis=1)
            np.add.at(g_table[d], symbols[t], to_gates)
            to_gates[:, 2 * h :] *= r
            g_bias[d] += to_gates[:, 2 * h :].sum(axis=0)
            g_inner[d] += state.T @ to_gates
            flow = flow * z + to_gates @ net.inner[d].T
    return loss, grads


def fit(crops: list[tuple[str, bytes]], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 13) -> Network | None:
    """A network for (language, bytes of up to STEPS) windows; those of fewer bytes than STEPS have text ends in them."""
    langs = sorted({lang for lang, _ in crops})
    if not langs:
        return None
    net, rng = new_network(langs, hidden, seed), np.random.default_rng(seed)
    symbols = np.full((STEPS, len(crops)), OUTSIDE, np.int16)
    for i, (_, text) in enumerate(crops):
        at = CONTEXT if len(text) < STEPS else 0
        text = text[: STEPS - at]
        symbols[at : at + len(text), i] = np.frombuffer(text, np.uint8)
    labels = np.array([langs.index(lang) for lang, _ in crops])
    params = net.params()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = epochs * -(-len(crops) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(crops))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, grads = gradients(net, symbols[:, some], labels[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            speed = rate * (1 - step / (total + 1))
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                g *= min(1.0, 1.0 / max(norm, 1e-12))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _readable() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def crops_of(docs: DataFrame, per_language: int = PER_LANGUAGE, crops: int = CROPS, seed: int = 13) -> list[tuple[str, bytes]]:
    """The sample that a network is fitted on, in a fixed order: (language, window)."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    named = docs.filter(~held_out() & F.col("lang").isNotNull() & _readable()).select("lang", "text")
    # Keys first: the texts of a language are ranked by hashes alone.
    keys = named.select("lang", F.sha2(F.concat(F.lit(f"{seed}:"), "text").cast("binary"), 256).alias("key"))
    # What is ranked is some six times the sample: keys are even, so the smallest lie below a share of them. There is
    # a row for each language, of which the network has an output each.
    seen = keys.groupBy("lang").agg(F.approx_count_distinct("key").alias("seen"))
    low = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / 2.0**48 <= 6.0 * per_language / F.greatest(F.col("seen"), F.lit(1))
    best = keys.join(F.broadcast(seen), "lang").filter(low).select("lang", "key").distinct()
    best = best.withColumn("rank", rank).filter(F.col("rank") <= per_language).drop("rank")  # a bounded sample
    named = named.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), "text").cast("binary"), 256))
    chosen = named.join(F.broadcast(best), ["lang", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, key, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "text")), strict=True):
                data = text.encode()
                rng = np.random.default_rng(int(key[:12], 16))
                for n, size in enumerate([STEPS] * crops + [int(x) for x in STEPS ** rng.uniform(0.2, 1, crops)]):  # whole windows, and short ones as if they were texts
                    start = int(rng.integers(0, max(0, len(data) - size) + 1))
                    start = data.rfind(b" ", 0, start + 1) + 1  # of a word
                    rows.append((lang, key, n, data[start : start + size]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["lang", "key", "n", "crop"])

    bound_batches(docs.sparkSession)
    found = chosen.mapInArrow(cut, "lang string, key string, n long, crop binary").distinct().collect()
    return [(r["lang"], bytes(r["crop"])) for r in sorted(found, key=lambda r: (r["lang"], r["key"], r["n"]))]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, crops: int = CROPS, **settings: float) -> Network | None:
    """A network from the rows of docs (doc_id, text, lang) that aren't held out."""
    return fit(crops_of(docs, per_language, crops), **settings)


def _batches(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.when(_readable(), F.col("text")).alias("text"))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    if net is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(net), np.array([*net.langs, UNKNOWN], object)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            means = reader.pooled(texts)
            best, known = means.argmax(axis=1), np.array([len(t) > 0 for t in texts], bool)
            best = np.where(known, best, len(net.langs))
            score = np.where(known, np.clip(means.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return _batches(docs).mapInArrow(run, _PREDICTED)


def label_positions(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, start, end, lang: the runs of bytes of each text whose most probable language is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            owner, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for of, symbols, found in reader.blocks(texts):
                inside = (symbols != OUTSIDE).T
                owner.append(np.repeat(of, CORE).reshape(-1, CORE)[inside])
                label.append(found.argmax(axis=0).T[inside])
            owner, label = np.concatenate(owner), np.concatenate(label)
            ends = np.flatnonzero((np.diff(owner, append=-1) != 0) | (np.diff(label, append=-1) != 0))
            starts = np.append(0, ends[:-1] + 1)[: len(ends)]
            base = np.searchsorted(owner, owner[ends]) if len(ends) else ends
            cols = [[ids[o] for o in owner[ends]], starts - base, ends + 1 - base, [net.langs[x] for x in label[ends]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "start", "end", "lang"])

    return _batches(docs).mapInArrow(run, _SPANS)


def report(documents: DataFrame) -> DataFrame:
    return predict(documents, learn(documents))
