import json

from talkledger.operators import payloads as p


def test_shapes(spark):
    cases = [
        None, "", "broken [", "[]", "7", '{"headers": ["a"]}', json.dumps([{"add": True, "rule_id": " 7 ", "score": "x"}, {}]), json.dumps([{"a": 1}, ["y", "r", 2.5, "t", "Pass", "", ""], "no", 3]),
        json.dumps({"columns": ["x", "y", "x"], "data": [[1, None, [2]], [3], {"x": 1}]}),
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, payload string")
    got = {}
    for r in p.records(df).orderBy("id", "row_n").collect():
        got.setdefault(r["id"], []).append(r["cells"])
    assert set(got) == {6, 7, 8}
    assert got[6] == [{"add": "true", "rule_id": " 7 ", "score": "x"}, {}]
    assert got[7] == [{"add": "y", "rule": "r", "score": "2.5", "text": "t", "model_label": "Pass", "qwen_label": "", "final_label": ""}]
    assert got[8] == [{"y": None, "x": "[2]"}, {"x": "3"}]
    rows = [tuple(r)[2:] for r in p.review_rows(p.records(df)).filter("id in (6, 7)").orderBy("id", "row_n").collect()]
    assert rows == [(True, "7", 0.0, "", "", "", ""), (False, "", 0.0, "", "", "", ""), (True, "r", 2.5, "t", "Compliant", "", "Compliant")]
