from lectern.cli import field, main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("termination clause agreement")
    at = ["--index", f"file://{tmp_path}/index"]
    assert main([*at, "index", str(tmp_path / "a.txt"), "--metadata", '{"n": 1}'], spark)["documents"] == 1
    found = main([*at, "search", "termination", "--filter", '{"n": 1}', "--rerank"], spark)
    assert [r["snippet"] for r in found] == ["termination clause agreement"]
    assert "1. [" in capsys.readouterr().out
    assert main([*at, "ask", "termination", "--json"], spark)["answer"].startswith("Found 1")
    assert main([*at, "stats"], spark) == {"documents": 1, "chunks": 1}
    assert main([*at, "diff", "nothing"], spark) is None and main([*at, "remove", "nothing"], spark) is False


def test_fields():
    assert field("due:date:when it: ends") == {"name": "due", "type": "date", "description": "when it: ends"}
    assert field("n") == {"name": "n", "type": "string", "description": ""}
