"""Ignore files of a tree, of the folders above it, and of the repository."""

from tessera.sources import trees


def test_ignore_files_of_all_places(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "settings"))
    files = {
        "settings/git/ignore": "*.bak\n",
        "repo/.git/info/exclude": "private/\n",
        "repo/.gitignore": "/src/made.py\n*.tmp\n",
        "repo/.ignore": "*.draft\n",
        "repo/src/.gitignore": "!keep.tmp\n",
        "repo/src/.ignore": "secret.py\n!kept.bak\n",
        **{f"repo/src/{name}": "x" for name in ("a.py", "made.py", "x.tmp", "keep.tmp", "old.bak", "kept.bak", "one.draft", "secret.py", "private/in.py", "deep/made.py", "deep/secret.py")},
        ".ignore": "a.py\n!a.py\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = [path for path, _ in trees.walk(str(tmp_path / "repo" / "src"))]
    assert found == ["a.py", "keep.tmp", "kept.bak", "deep/made.py"]


def test_no_repository(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / ".gitignore").write_text("*.py\n")  # above the tree, and of no repository
    (tmp_path / "out" / "a.py").write_text("x")
    assert [path for path, _ in trees.walk(str(tmp_path / "out"))] == ["a.py"]


def test_partitions_list_their_own_folders(spark, tmp_path):
    names = [f"{a}/{b}/f{k}.py" for a in "abc" for b in "xyz" for k in range(4)] + ["top.py", "a/own.py", "a/x/deep/er/down.py", "a/x/deep/no.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "a/x/.gitignore").write_text("f1.py\n")
    (tmp_path / "b/bad.py").write_bytes(b"\xff\xfe")
    wanted = sorted(path for path, _ in trees.walk(str(tmp_path)))
    assert "a/x/f1.py" not in wanted and "a/x/deep/er/down.py" in wanted and len(wanted) == len(names)
    for n in (1, 3, 7, 40):
        parts = trees.planned(str(tmp_path), n)
        assert sorted(path for p in parts for path, _ in trees.walk(str(tmp_path), part=p)) == wanted
        assert max(p.base.count("/") for p in parts) <= 2
    assert len(trees.planned(str(tmp_path), 40)) >= 20
    read = {r.path: r.content for r in trees.read_tree(spark, str(tmp_path), extensions="py", partitions=7).collect()}
    assert read == {name: name for name in wanted if name.endswith(".py") and name != "b/bad.py"}
    assert [tuple(r) for r in trees.unreadable(spark, str(tmp_path)).collect()] == [("b/bad.py", 2, "UnicodeDecodeError")]
    assert trees.list_tree(spark, str(tmp_path), maxSize=6).count() == sum(len(n) <= 6 for n in names) + 1
