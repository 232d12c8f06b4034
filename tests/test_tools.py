"""Reports of tools and servers, ignore files, renderings, signatures, and the command line."""

import json
import subprocess
import sys

import pytest

from arborlight import cli, render, trust
from arborlight.sources import lsp, reports
from arborlight.sources.workspace import ignore_rules, scan_workspace

SERVER = r"""
import json, sys
def send(**m):
    b = json.dumps({"jsonrpc": "2.0", **m}).encode(); sys.stdout.buffer.write(b"Content-Length: %d\r\n\r\n" % len(b) + b); sys.stdout.buffer.flush()
while True:
    n = 0
    while (line := sys.stdin.buffer.readline().strip()):
        n = int(line.split(b":")[1]) if line.lower().startswith(b"content-length") else n
    if not n: break
    m = json.loads(sys.stdin.buffer.read(n))
    if m.get("method") == "initialize":
        send(id=m["id"], result={"capabilities": {}}); send(id=9, method="workspace/configuration", params={"items": [1]})
    elif m.get("method") == "textDocument/didOpen":
        u = m["params"]["textDocument"]["uri"]; at = {"start": {"line": 2, "character": 4}, "end": {"line": 2, "character": 5}}
        send(method="textDocument/publishDiagnostics", params={"uri": u, "diagnostics": [{"range": at, "message": "old"}]})
        send(method="textDocument/publishDiagnostics", params={"uri": u, "diagnostics": [{"range": at, "severity": 2, "code": "E1", "message": "new"}]})
        send(method="textDocument/publishDiagnostics", params={"uri": "file:///elsewhere/x.py", "diagnostics": [{"range": at, "message": "out"}]})
    elif m.get("method") == "exit": break
"""


def test_language_servers_last_word_counts(tmp_path):
    (tmp_path / "server.py").write_text(SERVER)
    rows = lsp.collect([sys.executable, str(tmp_path / "server.py")], str(tmp_path), {"a b.py": "x"}, timeout=20)
    assert [(r[0], r[1], r[2], r[3], r[5], r[6]) for r in rows] == [("a b.py", 3, 5, "E1", "warning", "new")]
    with pytest.raises(RuntimeError):
        lsp.collect([sys.executable, "-c", "pass"], str(tmp_path), {}, timeout=5)
    assert lsp.from_uri(lsp.to_uri("/a b/ü%.py")) == "/a b/ü%.py" and lsp.from_uri("http://x") is None
    assert lsp.default_files(["b.py", "a.PY", "c.rs"], (".py",)) == ["a.PY", "b.py"]


def test_rule_engines_and_orchestration(spark, tmp_path):
    semgrep = json.dumps({"errors": [], "results": [{"check_id": "r1", "path": "a.py", "start": {"line": 3, "col": 2}, "extra": {"message": "m  x", "severity": "INFO"}}]})
    grep = json.dumps({"file": "b.ts", "ruleId": "r2", "message": "q", "severity": "error", "range": {"start": {"line": 0, "column": 0}}})
    ruff = '[{"filename": "a.py", "location": {"row": 1, "column": 2}, "code": "F401", "message": "m"}]'
    found, status = reports.collect(spark, {"semgrep": semgrep, "ast-grep": grep, "ruff": ruff, "tsc": "nonsense"})
    assert [(r.category, r.file, r.line, r.rule, r.confidence, r.level) for r in found.collect()] == [("diagnostic", "a.py", 1, "F401", 0.83, "medium"), ("rule", "a.py", 3, "r1", 0.7, "medium"), ("rule", "b.ts", 1, "r2", 0.85, "medium")]
    assert status["ruff"] == "ran" and status["tsc"].startswith("incomplete")
    assert reports.collect(spark, {"ruff": ruff}, least="error")[0].count() == 0
    for bad in ('{"errors": [1], "results": []}',):
        with pytest.raises(ValueError):
            list(reports.semgrep(bad))
    with pytest.raises(ValueError):
        list(reports.ast_grep(json.dumps({"file": "b", "ruleId": "r", "range": {"start": {"line": (1 << 32) - 1, "column": 0}}})))
    (tmp_path / "tsconfig.json").write_text("{}")
    assert reports.applicable(str(tmp_path)) == ["tsc"] and reports.extensions(str(tmp_path)) == ["json"]
    assert reports.run_tool(("no-such-program-here",), str(tmp_path))[0] is None and reports.run_tool((sys.executable, "-c", "print(7)"), str(tmp_path))[:2] == (0, "7\n")
    with pytest.raises(TimeoutError):
        reports.run_tool((sys.executable, "-c", "import time; time.sleep(9)"), str(tmp_path), timeout=0.5)
    assert [reports.completed("ruff", c, "", n) for c, n in ((None, 0), (0, 0), (1, 2), (1, 0), (9, 3))] == ["skipped", "ran", "ran", "incomplete", "incomplete"]


def test_ignore_files_are_honoured(spark, tmp_path):
    for name in ("a.py", "out/b.py", "keep/out/c.py", "x.gen.py", "deep/y.gen.py", "deep/z.py", "deep/only/q.py", "top/t.py", "deep/top/t.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# note\nout/\n!keep/out/\n*.gen.py\n/top\n")
    (tmp_path / "deep/.gitignore").write_text("!y.gen.py\nonly/**\n")
    assert {r.path for r in scan_workspace(spark, str(tmp_path)).collect()} == {"a.py", "keep/out/c.py", "deep/y.gen.py", "deep/z.py", "deep/top/t.py"}
    assert ignore_rules("", "\n#x\n   \n") == []


def test_renderings(spark):
    rows = [("r", f"f{i}", i, 0.5 + i / 10, "medium", "m") for i in range(5)]
    df = spark.createDataFrame(rows, "rule string, file string, line int, confidence double, level string, message string")
    report = render.capped(df, 2)
    assert [f["file"] for f in report["findings"]] == ["f4", "f3"] and report["truncated"]["total"] == 5 and sum(report["summary"].values()) == 5
    assert "showing 2 of 5" in render.text(report) and json.loads(render.pretty(report)) == report and "truncated" not in render.capped(df, 9)
    assert render.envelope(report)["untrusted"] and render.envelope(report)["truncated"]["shown"] == 2 and render.envelope(None, False)["ok"] is False


def test_signatures_hold_and_break(spark, tmp_path):
    signer = trust.Signer(spark)
    private, public = signer.keys()
    signed = signer.sign({"version": 1, "destinations": ["d"], "x": "é"}, private, public)
    assert signer.verify(signed)["x"] == "é"
    for change in ({"payload": {**signed["payload"], "x": "e"}}, {"signature": "00" * 64}, {"signature": "0f"}, {"public_key": signer.keys()[1].hex()}, {"payload": {"version": 2, "destinations": ["d"]}}, {"payload": {"version": 1, "destinations": []}}):
        with pytest.raises(ValueError):
            signer.verify({**signed, **change})
    (tmp_path / "a.txt").write_text("1")
    files, tree = trust.snapshot(str(tmp_path), ["a.txt"])
    assert len(tree) == 64 and trust.snapshot(str(tmp_path), ["a.txt", "a.txt"]) == (files, tree)
    (tmp_path / "l.txt").symlink_to(tmp_path / "a.txt")
    for bad in ("l.txt", "none", "../x"):
        with pytest.raises(ValueError):
            trust.snapshot(str(tmp_path), [bad])

    class Sees:
        def __init__(self, name, n):
            self.name, self.n = name, n

        def findings(self, root):
            return spark.range(self.n)

    say = lambda a, b, **k: trust.grade(spark, str(tmp_path), files, [Sees("a", a), Sees("b", b)], lambda d: d, **k)
    assert say(0, 0) == ("pass", False) and say(1, 2) == ("fail", False) and say(0, 1) == ("gate-untrusted", True) and say(1, 1, complete=False)[0] == "incomplete"
    (tmp_path / "a.txt").write_text("2")
    assert say(0, 0)[0] == "incomplete"
    flaky = iter([True, False])
    score, table = trust.self_test(spark, {"good": lambda: True, "flaky": lambda: next(flaky), "broken": lambda: 1 / 0, "also": lambda: True})
    assert score == 0.5 and {r.mutant for r in table.where("caught").collect()} == {"good", "also"}
    r = trust.receipt(signer, "pass", signed, tree, score, trust.Policy().raised({"mutation_score": 0.1, "runs": 5}), ["f"], 0, private, public)
    assert r["payload"]["verdict"] == "gate-untrusted" and r["payload"]["at"] == "1970-01-01T00:00:00Z" and signer.verify(r) and trust.Policy().raised({"runs": 5}).runs == 5


def test_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("import nothere\n\n\ndef main():\n    used()\n\n\ndef used():\n    return 1\n\n\ndef _gone():\n    return 2\n")
    (tmp_path / "test_a.py").write_text("from a import used\n\n\ndef test_used():\n    assert used() == 1\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    at = [str(tmp_path), "--store", str(tmp_path / ".s")]
    assert cli.run(spark, ["dead-code", *at, "--format", "json", "--fail-on", "high"]) == 1
    assert [f["symbol"] for f in json.loads(capsys.readouterr().out)["findings"]] == ["_gone"]
    assert cli.run(spark, ["dead-code", *at]) == 0 and "1 findings: 1 high" in capsys.readouterr().out
    assert cli.run(spark, ["find", str(tmp_path), "USED", *at[1:]]) == 0 and "used" in capsys.readouterr().out
    assert cli.run(spark, ["refs", str(tmp_path), "used", *at[1:]]) == 0 and "main" in capsys.readouterr().out
    assert cli.run(spark, ["impact", *at, "--symbol", "used"]) == 0 and "test_used" in capsys.readouterr().out
    assert cli.run(spark, ["map", *at]) == 0 and "def used()" in capsys.readouterr().out
    assert cli.run(spark, ["check-deps", *at]) == 0 and "undeclared-dependency" in capsys.readouterr().out
    assert cli.run(spark, ["index", *at]) == 0 and cli.run(spark, ["scip", *at]) == 0 and "no index" in capsys.readouterr().out
    (tmp_path / "test_a.py").write_text("import pytest\n\n\n@pytest.mark.skip\ndef test_used():\n    assert used()\n")
    assert cli.run(spark, ["weakening", str(tmp_path), "--base", "HEAD", "--fail-on", "high"]) == 1 and "added-skip" in capsys.readouterr().out
    assert cli.run(spark, ["verify", *at, "--base", "HEAD"]) == 1 and capsys.readouterr().out.startswith("fail")
    assert cli.run(spark, ["verify", *at]) == 0 and cli.run(spark, ["diagnostics", *at]) == 0
