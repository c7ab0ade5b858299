import json

from talkledger import cli
from talkledger.catalogue import RULES_JSON
from talkledger.operators import fitting
from talkledger.plans import loop
from talkledger.sources import versions


def test_train_and_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    rows = tmp_path / "rows.json"
    rows.write_text("\n".join(json.dumps({"disclaimer_id": "101", "anchor": "the of and by", "dialogue": f"{'the and of' if n % 2 else 'none'} {n}", "type": "compliant" if n % 2 else "non-compliant"}) for n in range(20)))
    out = str(tmp_path / "models")
    for model in ("verifier", "retriever"):
        cli.main(["train", "--model", model, "--input", str(rows), "--output", out])
    store = versions.Store(spark, out)
    assert set(store.state()["tables"]) == {"active/verifier", "active/retriever"}
    assert any(fitting.Verifier.of(store.table("active/verifier")).weights)
    calls = tmp_path / "calls"
    calls.mkdir()
    for n in range(6):
        (calls / f"{n}.txt").write_text(f"Agent: the of and by {n}\nUser: no")
    (tmp_path / "rules.json").write_text(RULES_JSON)
    cli.main(["loop", "--input", str(calls), "--rules", str(tmp_path / "rules.json"), "--output", str(tmp_path / "loop"), "--require-human-review"])
    assert loop.Run(versions.Store(spark, str(tmp_path / "loop")), "1").facts["status"] == loop.AWAITING
