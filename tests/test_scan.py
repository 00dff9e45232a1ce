from __future__ import annotations

import pytest

from graftwood.config import CompareConfig, allowed_extensions, load_env_file, with_env
from graftwood.operators import scan
from graftwood.sources.tree import IgnoreRules, count_lines, detect_language, scan_tree


@pytest.fixture
def tree(tmp_path):
    files = {
        "__init__.py": b"",
        "_private.py": b"x = 1\n",
        ".dot.py": b"y = 2",
        "pkg/a.py": b"a = 1\r\nb = 2\rc = 3",
        "pkg/bad.py": b"s = '\xff\xfe'\n",
        "pkg/deep/only/mod.GO": b"package x\n",
        "pkg/win.pyw": b"z\n",
        "tests/t.py": b"t\n",
        ".hidden/h.py": b"h\n",
        "gen/g.py": b"g\n",
        "pkg/skip_me.py": b"s\n",
        "README.md": b"no\n",
        "long/ten.py": b"l\n" * 10,
        "long/eleven.py": b"l\n" * 11,
        ".graftignore": b"# rules\n\ngen/\nskip_*.py\na/b/\n",
    }
    for name, raw in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    (tmp_path / "linked").symlink_to(tmp_path / "gen")
    (tmp_path / "alias.py").symlink_to(tmp_path / "_private.py")
    return tmp_path


def test_scan_of_a_tree(spark, tree):
    rows = {r["path"]: r for r in scan_tree(spark, str(tree), "A", CompareConfig(max_file_lines=10)).collect()}
    assert set(rows) == {"__init__.py", "_private.py", ".dot.py", "pkg/a.py", "pkg/bad.py", "pkg/deep/only/mod.GO", "long/ten.py", "alias.py"}
    assert rows["pkg/a.py"]["content"] == "a = 1\nb = 2\nc = 3" and rows["pkg/a.py"]["line_count"] == 3
    assert rows["pkg/bad.py"]["content"] == "s = ''\n"
    assert rows["__init__.py"]["content"] == "" and rows["__init__.py"]["line_count"] == 0
    assert rows["pkg/deep/only/mod.GO"]["language"] == "go" and rows["pkg/deep/only/mod.GO"]["dir"] == "pkg/deep/only"
    assert rows["alias.py"]["content"] == "x = 1\n"
    assert {r["repo"] for r in rows.values()} == {"A"}


def test_language_filter(spark, tree):
    paths = lambda *tokens: {r["path"] for r in scan_tree(spark, str(tree), "B", CompareConfig(languages=frozenset(tokens))).collect()}
    assert "pkg/win.pyw" in paths("python") and "pkg/win.pyw" not in paths("py")
    assert paths("go") == {"pkg/deep/only/mod.GO"}
    assert paths("nonsense") == set()


def test_a_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_tree(spark, str(tmp_path / "none"), "A")


def test_ignore_rules():
    rules = IgnoreRules.parse("# c\n\nbuild2/\n*.gen.py\n")
    assert rules.ignores_dir("build2") and rules.ignores_dir("node_modules") and not rules.ignores_dir("src")
    assert rules.ignores_file("x.gen.py") and rules.ignores_file("yarn.lock") and not rules.ignores_file("x.GEN.py")


def test_globs_in_sql_match_whole_names(spark):
    df = spark.createDataFrame([("a.py",), ("xa.py",), ("a.py\n",), ("aXpy",)], "n string")
    assert [r["n"] for r in df.filter(scan.glob_matches(df["n"], "a.py")).collect()] == ["a.py"]


@pytest.mark.parametrize("text,lines", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("\n\n", 2)])
def test_line_counts(spark, text, lines):
    from graftwood.functions.text import line_count

    assert count_lines(text) == lines
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(line_count(df["c"]).alias("n")).first()["n"] == lines


def test_languages_of_names(spark):
    from graftwood.functions.text import language

    names = {"a.PY": "python", "a.h": "c/cpp", "x/y.tsx": "typescript", "b.unknown": "unknown", ".py": "", "noext": ""}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r["p"]: r["l"] for r in df.select("p", language(df["p"]).alias("l")).collect()} == names
    assert detect_language("a.PY") == "python" and detect_language("b.unknown") == "unknown"


def test_extensions():
    assert ".pyw" not in allowed_extensions(frozenset()) and allowed_extensions({"Python"}) == {".py", ".pyw"}
    assert allowed_extensions({"ts"}) == {".ts"} and allowed_extensions({"pyw"}) == frozenset()


def test_env_file(tmp_path, monkeypatch):
    for k in ("OPENAI_API_KEY", "OPENAI_BASE_URL", "ANTHROPIC_API_KEY"):
        monkeypatch.delenv(k, raising=False)
    (tmp_path / ".graftwood.env").write_text("# c\nOPENAI_API_KEY = k1\nMODEL=m2\nRPS=5\nUSE_JSON_MODE=yes\n\nbad line\n")
    env = load_env_file(tmp_path)
    config = with_env(CompareConfig(rps=7.0), env)
    assert (config.api_key, config.model, config.rps, config.use_json_mode) == ("k1", "m2", 7.0, True)
    assert not with_env(CompareConfig(), env, frozenset({"use_json_mode"})).use_json_mode
    assert load_env_file(tmp_path / "none") == {}
