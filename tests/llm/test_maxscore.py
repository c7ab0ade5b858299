"""Operator 11 against scores of every document for every item, in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from talkledger.llm import maxscore as m


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def expected(docs, items, k=10):
    said = [(i, words(t)) for i, t in docs]
    said = [(i, w, Counter(w)) for i, w in said if w]
    n, length = len(said), sum(len(w) for _, w, _ in said)
    df = Counter(x for *_, c in said for x in c)
    out = []
    for item, text in sorted(set(x for x in items if x[1] is not None), key=repr):
        found = []
        for i, w, c in said:
            norm = 25 + (75 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * norm)) for x in words(text) if c[x])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def corpus(rng, n):
    common, rare = ["the", "a", "de", "Of"], [f"w{i}" for i in range(300)]
    some = lambda: " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, [1 / (i + 1) for i in range(300)], k=rng.randint(0, 12)))
    texts = [some() for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (7, texts[1]), (n, ""), (n + 1, "É«x» 9\x00A_b-ß [w1]" + " w3" * 5000)]
    docs += [(n + 10 + i, texts[2] + " w5") for i in range(80)]  # copies, whose scores tie
    return docs, [(i, some()) for i in range(25)] + [(1, "w1 w1 the É«x»"), (1, "w1 w1 the É«x»"), (2, "the w9"), (None, "w2 W3"), (90, None), (91, ""), (92, "absent"), (93, "a_B")]


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, words string").repartition(4)
    b = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, times int, tkey string")
    return sorted((tuple(r) for r in m.search(d, b, **how).collect()), key=repr)


def test_search(spark, monkeypatch):
    docs, items = corpus(random.Random(1), 700)
    want = expected(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_words=60) == want  # several blocks of items


def test_small_and_empty(spark):
    docs, items = corpus(random.Random(2), 12)
    assert run(spark, docs, items) == expected(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None), (2, " - ")], items) == []


def test_all_documents_hold_the_word(spark):
    """ln of little more than 1, of which the floor can be 0: no score, no row."""
    docs = [(i, "same word") for i in range(3000)]
    assert run(spark, docs, [(0, "same word"), (1, "same other")]) == expected(docs, [(0, "same word"), (1, "same other")])


def shard(rng, n):
    docs, items = corpus(rng, n)
    said = [Counter(words(t)) for _, t in docs]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in items for w in words(t)}))}
    rows = [(i, sum(c.values()), [vocabulary[w] for w in c if w in vocabulary], [x for w, x in c.items() if w in vocabulary]) for (i, _), c in zip(docs, said, strict=True)]
    queries = [Counter(vocabulary[w] for w in words(t)) for _, t in items]
    queries = [(np.array(list(q), int), np.array(list(q.values()), np.int64)) for q in queries if q]
    n_docs, length = sum(r[1] > 0 for r in rows), sum(r[1] for r in rows)
    df = Counter(w for r in rows for w in r[2])
    return rows, queries, np.array([m.weight(n_docs, df[i]) for i in range(len(vocabulary))]), n_docs, length


def test_windows_of_a_shard_do_not_matter(monkeypatch):
    rows, queries, w, n_docs, length = shard(random.Random(3), 900)
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["doc_id", "n", "words", "times"])
    results = []
    for size in (1, 37, 400, 10_000):
        monkeypatch.setattr(m, "WINDOW_DOCS", size)
        results.append([b.to_pydict() for b in m.rank_shard(iter([batch.slice(0, 500), batch.slice(500)]), queries, w, n_docs, length, 10)])
    assert all(r == results[0] for r in results)


def test_frequent_lists_are_probed_for_candidates_only():
    """With a threshold, an item's frequent words are asked about few documents, and nothing is lost."""
    rows, queries, w, n_docs, length = shard(random.Random(4), 3000)
    n, sizes = np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows])
    lists = m.Lists.of(n, sizes, np.concatenate([r[2] for r in rows]).astype(int), np.concatenate([r[3] for r in rows]), w, n_docs, length)
    every = asked = 0
    for said, often in queries:
        docs, scores = m.max_score(lists, said, often, 1)
        if len(scores) < 10:
            continue
        least, probed = int(np.sort(scores)[-10]), []
        some, best = m.max_score(lists, said, often, least, probed)
        assert dict(zip(some.tolist(), best.tolist(), strict=True)) == {d: s for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s >= least}
        slots = lists.slot[said]
        every += sum(int(lists.start[s + 1] - lists.start[s]) for s in slots if s >= 0)
        asked += sum(probed)
    assert asked < every / 2
