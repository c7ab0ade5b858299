"""Generation with hints and judge, resumed; chat clients with deadlines and answers that are kept."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from talkledger.plans import chat, generate

PROMPT = "rule_id string, scenario string, prompt_index int, system_instruction string, user_prompt string"
GOOD = [{"label": "Compliant", "text": "one two three four five"}, {"label": "Non-Compliant", "text": "Agent: this is another one of them"}]


def prompts(spark, n=3):
    return spark.createDataFrame([("1", "s", i, "", f"p{i}") for i in range(n)], PROMPT)


def test_generation_resumes(spark, tmp_path):
    def client(system, prompt, hint, number):
        return json.dumps(GOOD) if prompt == "p0" or (prompt == "p1" and number > 0 and hint) else "no json"

    out = str(tmp_path / "out")
    assert generate.generate(prompts(spark), client, out, least_kept=1, rounds=2) == {"done": 2, "left": 1}
    assert generate.generate(prompts(spark), lambda s, p, h, n: json.dumps(GOOD), out, least_kept=1, rounds=3) == {"done": 3, "left": 0}
    rows = generate.rows_of(spark, out)
    assert rows.count() == 6 and {r["round"] for r in rows.collect()} == {0, 1, 2}
    # Repeated, it asks nothing and adds nothing.
    def none(*_):
        raise AssertionError
    assert generate.generate(prompts(spark), none, out, least_kept=1, rounds=3) == {"done": 3, "left": 0} and rows.count() == 6


def test_a_lost_round_is_written_over(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    client = lambda s, p, h, n: json.dumps(GOOD)
    real = generate.assessed
    monkeypatch.setattr(generate, "assessed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        generate.generate(prompts(spark), client, out, least_kept=1)
    monkeypatch.setattr(generate, "assessed", real)
    assert generate.generate(prompts(spark), client, out, least_kept=1) == {"done": 3, "left": 0}
    assert generate.rows_of(spark, out).count() == 6


def test_hints_and_judge(spark, tmp_path):
    said = {
        "p0": "none", "p1": json.dumps([{"label": "Compliant"}, *GOOD]), "p2": json.dumps([{"label": "Compliant", "text": "too short"}]),
        "p3": json.dumps([{"label": "Compliant", "text": "well client: I say this to you"}]), "p4": json.dumps(GOOD), "p5": json.dumps(GOOD),
    }
    verdicts = {"p4": '<think>x</think>{"pass": true, "score": 8, "notes": " sharper "}', "p5": '{"pass": true, "score": 9}'}
    out = str(tmp_path / "out")
    got = generate.generate(prompts(spark, 6), lambda s, p, h, n: said[p], out, least_kept=1, rounds=1, judge=lambda s, p, a: verdicts.get(p, "broken"))
    assert got == {"done": 1, "left": 5}
    tried = {r["prompt_index"]: r for r in spark.read.parquet(f"{out}/attempts-0").collect()}
    h = generate.HINTS
    assert [tried[i]["hint"] for i in range(6)] == [h["array"], h["schema"], h["too_short"] % 5, h["multi_speaker"], h["other"] + " Supervisor notes: sharper", None]
    assert [tried[i]["score"] for i in range(6)] == [0, 0, 0, 0, 8, 9]
    assert sorted((r["type"], r["dialogue"], r["supervisor_score"], r["source_batch_size"]) for r in generate.rows_of(spark, out).collect()) == [("compliant", "one two three four five", 9, 2), ("non-compliant", "this is another one of them", 9, 2)]


def test_attempts_pauses_and_deadlines():
    calls, pauses, now = [], [], [0.0]

    def flaky(system, user, timeout):
        calls.append(timeout)
        now[0] += 10
        if len(calls) < 3:
            raise OSError("busy")
        return "yes"

    tick = lambda s: (pauses.append(s), now.__setitem__(0, now[0] + s))
    assert chat.persistent(flaky, "", "", chat.Limits(attempts=3, pause=1, deadline=60), tick, lambda: now[0]) == ("yes", None, 3)
    assert pauses == [1, 2] and calls == [60, 49, 37]
    calls.clear()
    now[0] = 0.0
    answer, failure, n = chat.persistent(flaky, "", "", chat.Limits(attempts=9, pause=1, deadline=15), tick, lambda: now[0])
    assert answer is None and failure.startswith("deadline") and n == 2


class Model(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append(body)
        user = body["messages"][1]["content"]
        reply = json.dumps({"message": {"content": f" to {user} "}} if user != "odd" else {"message": {"content": 5}}).encode()
        self.send_response(500 if user == "down" else 200)
        self.end_headers()
        self.wfile.write(reply)

    def log_message(self, *_):
        pass


def test_answers_over_http_are_kept(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = chat.HttpChat(f"http://127.0.0.1:{server.server_port}/api/chat", "m", timeout=5, json_mode=True, max_tokens=9)
    limits, kept = chat.Limits(in_flight=2, attempts=2, pause=0.01, deadline=10), str(tmp_path / "kept")
    df = spark.createDataFrame([(i, "s", u) for i, u in enumerate(["a", "a", "b", "down", "odd", None])], "id int, system string, user string")
    got = {r["id"]: (r["answer"], r["failure"]) for r in chat.answers(df, client, kept, limits).collect()}
    assert [got[i][0] for i in range(6)] == ["to a", "to a", "to b", None, None, "to"]
    assert "500" in got[3][1] and "no message" in got[4][1] and got[0][1] is None
    users = [b["messages"][1]["content"] for b in Model.asked]
    assert users.count("a") == 1 and users.count("down") == 2 and Model.asked[0]["format"] == "json" and Model.asked[0]["options"]["num_predict"] == 9
    Model.asked.clear()
    assert {r["id"]: r["answer"] for r in chat.answers(df, client, kept, limits).collect()} == {i: a for i, (a, _) in got.items()}
    assert {b["messages"][1]["content"] for b in Model.asked} == {"down", "odd"}  # only what has no answer
    server.shutdown()


def test_a_round_computes_its_parts_once(spark, tmp_path):
    """What the rows, the attempts and the counts of a round share are tables, written once."""
    import json
    import os

    from talkledger.plans import generate

    prompts = spark.createDataFrame([("r", "s", n, "", f"p{n}") for n in range(4)], "rule_id string, scenario string, prompt_index int, system_instruction string, user_prompt string")
    answer = json.dumps([{"label": "Compliant", "text": "one two three four five"}, {"label": "odd", "text": "dropped"}])
    out = str(tmp_path / "out")
    assert generate.generate(prompts, lambda system, prompt, hint, number: answer if prompt != "p3" else "no", out, least_kept=1, rounds=1) == {"done": 3, "left": 1}
    assert {"judged-0", "tried-0"} <= set(os.listdir(out))
    assert spark.read.parquet(f"{out}/judged-0").count() == 3 and spark.read.parquet(f"{out}/tried-0").count() == 4
    assert generate.rows_of(spark, out).count() == 3
