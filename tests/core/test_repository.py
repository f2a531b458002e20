import subprocess

import pytest

from lintlake.operators import code, findings, usage_rules
from lintlake.sources import changes, repository


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*arguments):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@example.com", *arguments], check=True, capture_output=True)

    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())

    git("init", "-q", "-b", "main")
    put("src/a.py", '"""Doc."""\n\n\ndef _old(x):\n    return 1\n')
    put("src/b.py", '"""Doc."""\r\nX = 1\r\n')
    put("docs/ü.md", "text\n")
    put("data.bin", "a\0b")
    put("sub/c.py", "Y = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    put("src/a.py", '"""Doc."""\n\n\ndef _old(x):\n    return 1\n\n\ndef _new(y):\n    return 1\n')
    put("new/d.py", "Z = 1\n")
    (root / "sub/c.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "two")
    put("src/a.py", "not committed")
    return str(root)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_files_of_a_revision(spark, repo):
    assert rows(repository.units(spark, repo, "HEAD~1", "p"), "project", "path", "file_type") == [("p", "docs/ü.md", "text"), ("p", "src/a.py", "python"), ("p", "src/b.py", "python"), ("p", "sub/c.py", "python")]
    head = {r["path"]: r["source"] for r in repository.units(spark, repo).collect()}
    assert head["src/b.py"] == '"""Doc."""\nX = 1\n' and "_new" in head["src/a.py"] and "sub/c.py" not in head


def test_path_filters_reach_the_listing(spark, repo):
    frame = repository.units(spark, repo, scope=("src",))
    assert rows(frame, "path") == [("src/a.py",), ("src/b.py",)]
    reader = repository.RevisionReader({"path": repo})
    left = list(reader.pushFilters([repository.StringStartsWith(("path",), "src/"), repository.EqualTo(("project",), "p")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [p for part in reader.partitions() for p, _ in part.files] == ["src/a.py", "src/b.py"]


def test_changed_files_and_regions(spark, repo, monkeypatch):
    monkeypatch.setattr(repository, "TASK_FILES", 1)
    assert rows(repository.units(spark, repo, base="HEAD~1"), "path") == [("new/d.py",), ("src/a.py",)]
    found = repository.regions(spark, repo, "HEAD~1", project="p")
    assert rows(found.where("file_path = 'src/a.py'"), "project", "file_path", "start", "end") == [("p", "src/a.py", 6, 9)]
    assert {r["file_path"] for r in found.collect()} == {"src/a.py", "new/d.py", "sub/c.py"}
    pruned = changes.in_changed_files(repository.units(spark, repo, project="p"), found)
    assert rows(pruned, "path") == [("new/d.py",), ("src/a.py",)]


def test_new_findings_against_the_base_snapshot(spark, repo):
    """Two revisions, one join: what the head has and the base lacks."""
    head, base = (usage_rules.unused_parameters(code.nodes(repository.units(spark, repo, r, "p"))) for r in ("HEAD", "HEAD~1"))
    assert rows(base, "symbol") == [("_old",)]
    assert rows(findings.new_only(head, base), "file_path", "symbol", "line") == [("src/a.py", "_new", 8)]


def test_unknown_revisions_say_so(spark, repo, tmp_path):
    with pytest.raises(repository.RepositoryError):
        repository.resolve(repo, "none")
    with pytest.raises(repository.RepositoryError):
        repository.resolve(str(tmp_path), "HEAD")
