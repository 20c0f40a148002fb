import json
import subprocess

import pytest

from graphloom import cli

from .test_rust import FILES, write


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = write(tmp_path_factory.mktemp("cli"), FILES)
    assert cli.main(["index", str(folder)], spark) == 0
    return str(folder)


def ask(spark, capsys, project, *args):
    code = cli.main([*args, "--project", project], spark)
    out, err = capsys.readouterr()
    return code, out, err


def test_answers(spark, capsys, project):
    code, out, _ = ask(spark, capsys, project, "query", "trace", "summarise", "--direction", "down")
    assert code == 0 and [r["name"] for r in json.loads(out)["rows"]] == ["parse_entry"]
    code, out, _ = ask(spark, capsys, project, "query", "inspect", "push")
    assert json.loads(out)["kind"] == "ambiguous" and json.loads(out)["count"] == 2
    code, out, _ = ask(spark, capsys, project, "query", "inspect", "check")
    assert json.loads(out)["source"]["content"].startswith("fn check(item") and json.loads(out)["source"]["line_count"] == 3
    code, out, _ = ask(spark, capsys, project, "query", "inspect", "check", "--no-source")
    assert "source" not in json.loads(out)
    code, out, _ = ask(spark, capsys, project, "query", "risk", "check")
    assert not any("public" in h for h in json.loads(out)["hints"])
    code, out, _ = ask(spark, capsys, project, "query", "risk", "parse_entry")
    assert any("public" in h for h in json.loads(out)["hints"])
    code, out, _ = ask(spark, capsys, project, "analyze", "refactor-order", "summarise", "parse_entry", "no_such_symbol")
    doc = json.loads(out)
    assert [r["id"].rsplit("::")[-1] for r in doc["rows"]] == ["parse_entry", "summarise"] and doc["unresolved"] == ["no_such_symbol"]
    code, _, err = ask(spark, capsys, project, "query", "trace", "parse_entyr")
    assert code == 1 and "parse_entry" in err


def test_diff_with_a_commit(spark, capsys, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org", *a], check=True, capture_output=True)
    write(tmp_path, FILES | {".gitignore": ".graphloom/\n"})
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    write(tmp_path, {"src/report.rs": FILES["src/report.rs"] + "\npub fn again() {\n    summarise(&[]);\n}\n"})
    assert cli.main(["index", str(tmp_path)], spark) == 0
    capsys.readouterr()
    code, out, err = ask(spark, capsys, str(tmp_path), "analyze", "diff", "--base", "HEAD")
    assert code == 0, err
    doc = json.loads(out)
    assert [r["file"] for r in doc["rows"]] == ["src/report.rs"] and [t["name"] for t in doc["changed_targets"]] == ["tally"]
    assert {e["edge"].split(" [")[1] for e in doc["edges"]} == {"calls]", "declares]"} and all(e["change"] == "added" and "again" in e["edge"] for e in doc["edges"])
    code, out, err = ask(spark, capsys, str(tmp_path), "analyze", "hotspots")
    assert code == 0 and json.loads(out)["count"] == 4


@pytest.mark.parametrize("command", ["query stats", "query summary", "query symbols --kind function", "query find entry", "query scope src/ledger.rs", "query impact parse_entry", "query risk parse_entry", "query path summarise parse_entry", "query export --kind dot", "query export --kind mermaid", "query export", "nav guide entry", "nav quality", "nav health", "nav report", "nav map", "nav retrieve entry", "analyze deps", "analyze fanout", "analyze tests"])
def test_every_command(spark, capsys, project, command):
    code, out, err = ask(spark, capsys, project, *command.split())
    assert code == 0 and out.strip(), err
