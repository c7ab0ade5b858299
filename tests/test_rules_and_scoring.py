import json

import pytest
from pyspark.sql import functions as F

from talkledger.operators import rules, scoring


def parsed(spark, **anchors):
    text = json.dumps({k: {"Criteria": "crit " + k, **({} if a is ... else {"anchor": a})} for k, a in anchors.items()} | {"x": 3})
    return rules.parse_rules(spark.createDataFrame([(text,)], "value string"))


def test_claims_of_anchor_shapes(spark):
    r = parsed(spark, b="one", a={"mandatory": ["m0", " ", 7, "m3"], "standard": ["s0"]}, c={"mandatory": []}, d=None, e=..., f="  ")
    got = [tuple(x) for x in rules.claims(r).orderBy("claim_id").collect()]
    assert got == [
        (0, "b", "single", 0, "one"), (1, "a", "mandatory", 0, "m0"), (2, "a", "mandatory", 3, "m3"), (3, "a", "standard", 0, "s0"),
        (4, "c", "single", 0, "crit c"), (5, "d", "single", 0, "crit d"), (6, "e", "single", 0, "crit e"), (7, "f", "single", 0, "crit f"),
    ]


def test_list_anchor_is_an_error_for_claims(spark):
    with pytest.raises(Exception, match="is a list"):
        rules.claims(parsed(spark, a=["x"])).collect()


def test_rubric_and_selection(spark):
    r = parsed(spark, a="one", b={"mandatory": ["m", ""], "standard": ["s"]})
    assert rules.rubric(r).filter("rule_id = 'b'").first()["rubric"].endswith("compliant:\n- m")
    assert [x["rule_id"] for x in rules.select_rules(r, ["a", "b"], ["b"]).collect()] == ["a"]
    assert rules.select_rules(r, [], []).count() == 2


def test_resolve_list_anchor(spark):
    r = parsed(spark, one=["only"], two=["p", "q"])
    rows = spark.createDataFrame([("one", None, None), ("two", None, None), ("two", None, "1"), ("two", " e ", "0")], "disclaimer_id string, anchor string, prompt_index string")
    assert [x["resolved"] for x in rules.resolve_anchor(rows, r).collect()] == ["only", None, "q", "e"]


def verdicts(spark, claims):
    """claims: (type, score, passed) of one rule."""
    rows = [("t", n, "r", kind, n, f"a{n}", ver, 0.0, f"x{n}", ok, [(f"h{n}", 0.0, ver)]) for n, (kind, ver, ok) in enumerate(claims)]
    schema = "transcript_id string, claim_id int, rule_id string, claim_type string, claim_ord int, anchor string, ver double, retr double, text string, passed boolean, for_review array<struct<text:string,retr:double,ver:double>>"
    t = spark.createDataFrame([("t",)], "transcript_id string")
    r = spark.createDataFrame([("r", 0)], "rule_id string, rule_pos int")
    x = scoring.rule_results(t, r, spark.createDataFrame(rows, schema)).first()
    return x["kind"], x["passed"], x["score"], x["evidence"], None if x["for_review"] is None else [h["text"] for h in x["for_review"]]


def test_rule_verdicts(spark):
    m, s, o = "mandatory", "standard", "single"
    assert verdicts(spark, [(o, 0.9, True)]) == ("single", True, 0.9, "x0", None)
    assert verdicts(spark, [(m, 0.9, True), (m, 0.4, False), (m, 0.4, False)]) == ("mandatory", False, 0.4, "x1", ["h1", "h2"])
    assert verdicts(spark, [(s, 0.4, False), (s, 0.6, True), (s, 0.6, True)]) == ("standard", True, 0.6, "x1", None)
    assert verdicts(spark, [(m, 0.8, True), (s, 0.3, False)]) == ("mixed", False, 0.3, "x1", ["h1"])
    assert verdicts(spark, [(m, 0.2, False), (s, 0.3, False)]) == ("mixed", False, 0.2, "x0", ["h0"])
    assert verdicts(spark, [(m, 0.2, False), (s, 0.9, True)]) == ("mixed", False, 0.2, "x0", ["h0"])
    assert verdicts(spark, [(m, 0.8, True), (s, 0.7, True)]) == ("mixed", True, 0.7, "x1", None)
    assert verdicts(spark, []) == ("empty", False, 0.0, "", [])


def test_hits_keep_first_of_equals_and_claims_without_hits(spark):
    chunks = spark.createDataFrame([("t", 0, "alpha x"), ("t", 1, "alpha y"), ("t", 2, "beta")], "transcript_id string, chunk_id int, chunk string")
    claims = spark.createDataFrame([(0, "r", "single", 0, "alpha")], "claim_id int, rule_id string, claim_type string, claim_ord int, anchor string")
    s = scoring.Settings(top_k=2)
    hits = scoring.hits(chunks, claims, s)
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == [0, 1]
    both = spark.createDataFrame([("t",), ("u",)], "transcript_id string")
    rows = {r["transcript_id"]: r for r in scoring.claim_results(both, claims, hits, s).collect()}
    assert rows["t"]["text"] == "alpha x" and rows["t"]["passed"]
    assert (rows["u"]["ver"], rows["u"]["passed"], rows["u"]["text"], rows["u"]["for_review"]) == (0.0, False, "", [])


def test_band_edges(spark):
    from talkledger.operators.review import in_band

    df = spark.createDataFrame([(x,) for x in (0.2999, 0.30, 0.4999, 0.6999, 0.70)], "v double")
    assert [r[0] for r in df.select(in_band(F.col("v"))).collect()] == [False, True, True, True, False]


def test_stated_sets_in_blocks(spark):
    rows, stated = spark.range(7).toDF("a"), spark.createDataFrame([(n, f"t{n}") for n in range(10)], "b int, c string")
    whole = sorted(map(tuple, scoring.against(rows, stated).collect()))
    assert len(whole) == 70 and sorted(map(tuple, scoring.against(rows, stated, most=3).collect())) == whole
    assert scoring.against(rows, stated.limit(0), most=3).count() == 0


def test_top_k_in_blocks(spark):
    """Ties, copies and vectors without a cosine, in blocks of a few rows, against every pair."""
    import random

    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from talkledger.operators import scoring

    rng = random.Random(5)
    rows = [(n, [float(rng.randint(-2, 2)) for _ in range(4)]) for n in range(60)]
    rows += [(60, None), (61, [0.0] * 4), (62, [1.0, None, 0.0, 0.0]), (63, [1.0, 2.0]), (64, rows[1][1]), (65, rows[1][1]), (66, [float("nan"), 0.0, 1.0, 0.0]), (67, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.filter("vec_id % 3 = 0 or vec_id > 59")
    pairs = e.crossJoin(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "vec_id", F.round(scoring.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = sorted(map(str, pairs.withColumn("rank", rank).filter("rank <= 4").collect()))
    for block in (8192, 7):
        assert sorted(map(str, scoring.top_k(q, e, 4, q.count(), block).select("query_id", "vec_id", "score", "rank").collect())) == want
    assert scoring.top_k(q.limit(0), e, 4, 0).count() == 0


def test_half_up_is_sparks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from talkledger.operators import scoring

    x = [0.1234565, 0.1234575, -0.0000005, 0.0000005, 0.9999995, 0.12345649999999, 1e-9, -1e-9, 0.0, *np.random.default_rng(1).uniform(-1, 1, 200).tolist()]
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert scoring.half_up(np.array([x])).tolist() == [want]
