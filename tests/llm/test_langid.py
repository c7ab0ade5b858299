"""Operator 13: its gradients against differences, its reader against a plain loop, its predictions held out."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkledger.llm import langid as m

SF = "/root/testdata/sf0.01"


def plain(net, text):
    """Probabilities at every byte, one byte at a time, for a text of one window."""
    h = net.inner.shape[1]
    symbols = [m.OUTSIDE] * m.CONTEXT + list(text) + [m.OUTSIDE] * (m.STEPS - m.CONTEXT - len(text))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = []
    for d in (0, 1):
        state, seen = np.zeros(h), {}
        for t in range(m.STEPS) if d == 0 else reversed(range(m.STEPS)):
            x, y = net.table[d][symbols[t]].astype(float), state @ net.inner[d]
            z, r = sigmoid(x[:h] + y[:h]), sigmoid(x[h : 2 * h] + y[h : 2 * h])
            state = (1 - z) * np.tanh(x[2 * h :] + r * (y[2 * h :] + net.bias[d])) + z * state
            seen[t] = state
        states.append(seen)
    out = []
    for t in range(m.CONTEXT, m.CONTEXT + len(text)):
        p = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.out + net.out_bias)
        out.append(p / p.sum())
    return np.array(out)


def test_gradients():
    net = m.new_network(["a", "b", "c"], hidden=3)
    net = m.Network(net.langs, *[p.astype(float) + 0.05 for p in net.params()])
    rng = np.random.default_rng(0)
    symbols, labels = rng.integers(0, 257, (m.STEPS, 4)), np.array([0, 2, 1, 1])
    _, grads = m.gradients(net, symbols, labels)
    for p, g in zip(net.params(), grads, strict=True):
        flat = p.reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            before = flat[i]
            losses = []
            for e in (1e-5, -1e-5):
                flat[i] = before + e
                losses.append(m.gradients(net, symbols, labels)[0])
            flat[i] = before
            assert g.reshape(-1)[i] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_reader_equals_a_plain_loop():
    net = m.new_network(["x", "y"], hidden=5)
    net.bias[:] = 0.3
    texts = [b"Le chat, \xc3\xa9t\xc3\xa9.", b"a", b"", b"z" * 77]
    got = m.Reader(net).pooled(texts)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx(plain(net, t).mean(axis=0) if t else [0, 0], abs=1e-5)
    long = b"Some words of a text. " * 500
    flat, starts, owner = m.windows_of([long, b"", b"end"])
    assert len(starts) == -(-len(long) // m.CORE) + 1 and set(owner) == {0, 2}
    core = flat[starts[:, None] + np.arange(m.CONTEXT, m.CONTEXT + m.CORE)]
    assert bytes(core[owner == 0].reshape(-1)[: len(long)].astype(np.uint8)) == long


@pytest.fixture(scope="module")
def net(spark):
    return m.learn(spark.read.parquet(f"{SF}/documents.parquet"), per_language=100, crops=2)


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = m.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def test_learns_only_from_others(spark):
    """Neither held-out rows nor other columns reach the fit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("text", F.when(m.held_out(), F.lit("zzz")).otherwise(F.col("text"))).withColumn("lang", F.when(m.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert m.crops_of(docs, 20, 1) == m.crops_of(changed, 20, 1)


def test_defined_cases(spark, net):
    rows = [(1, None), (2, ""), (3, " 12-3. "), (None, "The thing and the other."), (5, "The thing and the other. " * 9000), (6, "é"), (6, "é")]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in m.predict(docs, net).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == got[5]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert m.predict(docs, net).count() == 7 and m.predict(docs.limit(0), net).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert m.learn(unlabelled) is None and {r["lang_pred"] for r in m.report(unlabelled).collect()} == {"und"}


def test_labels_of_positions(spark, net):
    text = "The other of these was and that the thing is with them. " * 4 + "Le que vous avez dans les rues de la ville qui pour nous. " * 4
    got = sorted(tuple(r) for r in m.label_positions(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), net).collect())
    assert [g[0] for g in got] == [1] * len(got) and got[0][1] == 0 and got[-1][2] == len(text)
    assert all(a[2] == b[1] and a[3] != b[3] for a, b in zip(got, got[1:], strict=False))
    half = text.index("Le que")
    right = {"en": sum(min(e, half) - s for _, s, e, x in got if x == "en" and s < half), "fr": sum(e - max(s, half) for _, s, e, x in got if x == "fr" and e > half)}
    assert right["en"] > 0.7 * half and right["fr"] > 0.7 * (len(text) - half)
