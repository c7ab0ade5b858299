"""The nearest rows against difflib and sets on all pairs; coverage, extension rows and their merge."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from talkledger.operators import coverage, similar


def ratio(a, b):
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / max(1, len(a | b))


def some_texts(rng, n, longest=14):
    said = ["the", "of", "fee", "change", "Before", "confirm", "account", "é", "identity", "a"]
    texts = [" ".join(rng.choices(said, k=rng.randint(0, longest))) for _ in range(n)]
    return [t if rng.random() < 0.8 else t.replace("e", "", 2) + " x" for t in texts] + ["", "  ", texts[0], texts[0].upper()]


@pytest.mark.parametrize(("measure", "plain"), [(similar.block_ratio, ratio), (similar.token_jaccard, jaccard)])
def test_nearest_equals_all_pairs(spark, measure, plain):
    rng = random.Random(1)
    rows = [(rng.choice("pq"), rng.choice(["C", "N"]), pos, t) for pos, t in enumerate(some_texts(rng, 150) + some_texts(rng, 10, 90))]
    items = [(f"i{n}", rng.choice("pqr"), rng.choice(["C", "N"]), t) for n, t in enumerate(some_texts(rng, 25) + some_texts(rng, 4, 80))]
    df = spark.createDataFrame(items, "item_id string, k string, want string, text string")
    rf = spark.createDataFrame(rows, "k string, label string, pos long, text string")
    want = {}
    for item, k, side, text in items:
        for same in (True, False):
            met = sorted((-float(similar.rounded(plain(text, t))), pos) for k2, label, pos, t in rows if k2 == k and (label == side) == same)
            want |= {(item, same, n + 1): (pos, -s) for n, (s, pos) in enumerate(met[:3])}
    for sizes in ((4096, 1024), (17, 5)):  # one task a key, and many
        got = {(r["item_id"], r["same"], r["rank"]): (r["pos"], r["sim"]) for r in similar.nearest(df, rf, ["k"], measure, 3, *sizes).collect()}
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-9) for x in want)


def test_bounds_hold_and_spare_most_pairs():
    import numpy as np

    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"], k=12)) for _ in range(400)]
    index = similar.BlockIndex(texts, np.arange(400))
    for a in texts[:20]:
        for b in texts[:60]:
            lcs = similar.common_subsequence(similar.places(a), len(a), b)
            assert 2 * lcs / (len(a) + len(b)) >= ratio(a, b) - 1e-12
    asked = 0
    for a in texts[:20]:
        index.asked = 0
        cut = a[:-3].strip()
        found = index.near(cut, 1, np.arange(400))
        asked += index.asked
        assert -found[0][0] == pytest.approx(max(ratio(cut, t) for t in texts), abs=1e-6)
    assert asked < 20 * 400 / 4


def test_coverage_extension_and_merge(spark):
    items = spark.createDataFrame(
        [("a", "r", "X  y", "Compliant", " Before I confirm ", "t1", 1), ("b", "r", "x y", "Compliant", "zzz", "t1", 2), ("c", "r", "other", "Non-Compliant", "Before I confirm", "t2", 3)],
        "item_id string, rule_id string, anchor string, label string, text string, transcript_id string, row_pos long",
    )
    rows = coverage.pool(spark.createDataFrame([("r", "x y", "Compliant", "before i confirmed", 1, 5), ("r", "x y", "Non-Compliant", "zzz", 1, 6)], "rule_id string, anchor string, label string, dialogue string, sample_weight int, pos long"))
    analysed = coverage.analyse(items, rows)
    assert {r["item_id"]: r["status"] for r in analysed.collect()} == {"a": "covered", "b": "gap", "c": "gap"}
    variants = spark.createDataFrame([(i, p, t) for i in "ab" for p, t in ((2, "v2"), (0, " v0 "), (1, " "), (3, "v3"))] + [("c", 0, "before  I confirm")], "item_id string, pos int, text string")
    made = coverage.extend(items, analysed, variants)
    got = sorted((r["review_id"], r["n"], r["dialogue"], r["source"]) for r in made.collect())
    assert got == [("a", 0, "Before I confirm", "reviewed_phrase"), ("b", 0, "zzz", "reviewed_phrase"), ("b", 1, "v0", "coverage_gap_generated"), ("b", 2, "v2", "coverage_gap_generated"), ("c", 0, "Before I confirm", "reviewed_phrase"), ("c", 1, "before  I confirm", "coverage_gap_generated")]
    old = made.filter("review_id = 'b' and n = 0").select("disclaimer_id", "anchor", F.upper("dialogue").alias("dialogue"), "type", "row_pos", "n")
    merged, added = coverage.merge_extensions(old, made)
    assert tuple(added.first()) == (5 - 0, 4) and merged.count() == 5
    assert "ZZZ" in {r["dialogue"] for r in merged.collect()}
    none, zero = coverage.merge_extensions(made, made.limit(0))
    assert tuple(zero.first()) == (0, 0) and none.count() == 5


def test_common_subsequences_at_once_and_copies_compared_once():
    import numpy as np

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcde é", k=rng.choice([0, 1, 20, 63, 64, 65, 127, 128, 129, 200]))) for _ in range(120)]
    index = similar.BlockIndex(texts, np.arange(len(texts)))
    for a in [t for t in texts if t][:40] + ["zz", "a" * 64, "ab" * 64]:
        want = [similar.common_subsequence(similar.places(a), len(a), b) for b in index.texts]
        assert index.common(a, np.arange(len(index.texts))).tolist() == want
    few = [t for t in dict.fromkeys(texts) if len(t) > 10][:20]
    index = similar.BlockIndex(few * 50, np.arange(1000))
    found = index.near("abcde edcba abcde", 3, np.arange(1000))
    assert index.asked <= 20  # not 50 times as many
    met = sorted((-float(similar.rounded(ratio("abcde edcba abcde", t))) if t == " ".join(t.lower().split()) else -float(similar.rounded(similar.matching_ratio("abcde edcba abcde", t))), n) for n, t in enumerate(few * 50))
    assert [(s, p) for s, p, _ in found] == met[:3]


def test_pairs_are_matched_at_once_as_difflib_does():
    import numpy as np

    rng = random.Random(5)
    for said in ("ab", "abcde é", "abcdefghijklmnop ß€"):
        texts = ["".join(rng.choices(said, k=rng.choice([0, 1, 2, 5, 20, 64, 120, 199, 200, 250]))) for _ in range(60)]
        index = similar.BlockIndex(texts, np.arange(60))
        asking = [*texts[:20], "zz", "a" * 300, "ab" * 70]
        of, some = np.repeat(np.arange(len(asking)), len(index.texts)), np.tile(np.arange(len(index.texts)), len(asking))
        got = index.matched(asking, of, some).tolist()
        assert got == [sum(m.size for m in SequenceMatcher(None, asking[a], index.texts[b]).get_matching_blocks()) for a, b in zip(of, some)]
        assert index.alone == len(asking) * int((index.sizes >= 200).sum())
        long = [t for t in asking if len(t) > 128]
        assert all(index.common(a, np.arange(len(index.texts))).tolist() == [similar.common_subsequence(similar.places(a), len(a), b) for b in index.texts] for a in long)
    words = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=12)) for _ in range(300)]
    index = similar.BlockIndex(words, np.arange(300))
    items = [(t[3:-3].strip(), np.arange(300)) for t in words[:20]]
    got = index.nearest(items, 2)
    assert index.asked > 100 and index.alone == 0  # compared in full, but not one by one
    assert [[(s, int(p)) for s, p, _ in f] for f in got] == [sorted((-float(similar.rounded(similar.matching_ratio(x, t))), n) for n, t in enumerate(words))[:2] for x, _ in items]


def test_rows_are_sent_once_for_many_items_of_a_cheap_measure(spark, monkeypatch):
    from dataclasses import replace

    rng = random.Random(7)
    said = [f"w{n}" for n in range(60)]
    items = spark.createDataFrame([(n, "p", rng.choice("CN"), " ".join([f"i{n}", *rng.choices(said, k=12)])) for n in range(200)], "item_id long, k string, want string, text string")
    rows = spark.createDataFrame([("p", rng.choice("CN"), n, " ".join([f"r{n}", *rng.choices(said, k=12)])) for n in range(300)], "k string, label string, pos long, text string")
    sent = spark.sparkContext.accumulator(0)
    plain = similar.token_jaccard.index

    def counted(texts, pos):
        sent.add(len(texts))
        return plain(texts, pos)

    got = sorted(similar.nearest(items, rows, ["k"], replace(similar.token_jaccard, index=counted), 3).collect())
    assert len(got) == 200 * 6
    assert sent.value == 300  # not once more for every few items
    monkeypatch.setattr(similar, "BYTES", 4000)  # long texts make more blocks
    assert sorted(similar.nearest(items, rows, ["k"], replace(similar.token_jaccard, index=counted), 3).collect()) == got
    assert sent.value > 600


def test_word_sets_with_frequent_and_rare_words():
    import numpy as np

    rng = random.Random(8)
    texts = ["", *[" ".join(sorted({rng.choice("ab"), *rng.choices([f"w{n}" for n in range(900)], k=rng.randint(0, 9))})) for _ in range(400)]]
    pos = np.array(rng.sample(range(5000), len(texts)))
    index = similar.TokenIndex(texts, pos)
    assert 0 < len(index.matrix) < len(index.number)  # some words are frequent, some are not
    some = np.array(sorted(rng.sample(range(len(texts)), 150)))
    asked = ["", "a", "zz", *texts[:80]]
    got = index.nearest([(t, some) for t in asked], 4)
    for text, found in zip(asked, got, strict=True):
        assert [(s, int(p)) for s, p, _ in found] == sorted((-float(similar.rounded(jaccard(text, texts[r]))), int(pos[r])) for r in some)[:4]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_regressions_read_cases_that_were_joined_once(spark):
    """Items and pool come of one table of labelled documents."""
    import __spark_entry__

    plan = _optimized(__spark_entry__.queries()["regression_diagnosis"](spark, "/root/testdata/sf0.001"))
    assert "n_chars" not in plan  # no scan of all documents
    assert plan.count("FlatMapCoGroupsInArrow") == 1



def test_merged_diagnoses_compare_once(spark):
    """Both reports are made of one comparison, not each of its own."""
    import __spark_entry__

    plan = _optimized(__spark_entry__.queries()["merged_diagnoses"](spark, "/root/testdata/sf0.001"))
    assert "n_chars" not in plan  # no scan of all documents
    assert plan.count("FlatMapCoGroupsInArrow") == 1



def test_coverage_reads_cases_that_were_joined_once(spark):
    """Items and pool come of one table of labelled documents."""
    import __spark_entry__

    plan = _optimized(__spark_entry__.queries()["coverage_similarity"](spark, "/root/testdata/sf0.001"))
    assert "n_chars" not in plan  # no scan of all documents
    assert plan.count("FlatMapCoGroupsInArrow") == 1



def test_extension_compares_once(spark):
    """Reviewed phrases and variants are made of one comparison."""
    import __spark_entry__

    plan = _optimized(__spark_entry__.queries()["extension_rows"](spark, "/root/testdata/sf0.001"))
    assert "n_chars" not in plan  # no scan of all documents
    assert plan.count("FlatMapCoGroupsInArrow") == 1
