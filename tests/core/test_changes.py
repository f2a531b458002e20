"""Unified diffs and ignore files."""

from lintlake.operators import project_text
from lintlake.sources import changes

PATCH = """diff --git a/app/one.py b/app/one.py
index 1..2 100644
--- a/app/one.py
+++ b/app/one.py
@@ -1,2 +1,3 @@ def f
 x
@@ -9 +4,2 @@
@@ -20,2 +30,0 @@
diff --git a/app/new.py b/app/new.py
new file mode 100644
--- /dev/null
+++ b/app/new.py
@@ -0,0 +1,5 @@
diff --git a/app/gone.py b/app/gone.py
--- a/app/gone.py
+++ /dev/null
@@ -1,5 +0,0 @@
diff --git "a/odd name.py" "b/odd name.py"
--- "a/odd name.py"
+++ "b/odd name.py"
@@ -1 +1 @@
"""


def test_regions(spark):
    got = changes.changed_regions(spark.createDataFrame([("p", PATCH), ("q", ""), ("r", None)], "project string, patch string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("p", "app/one.py", 1, 5, False), ("p", "app/one.py", 30, 30, False), ("p", "app/new.py", None, None, True), ("p", "app/gone.py", 1, 1, False), ("p", "odd name.py", 1, 1, False)], key=str)


def test_plain_patches_without_git_headers(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n--- a/y.py\n+++ b/y.py\n@@ -1 +7 @@\n"
    got = changes.changed_regions(spark.createDataFrame([("p", patch)], "project string, patch string")).collect()
    assert sorted(map(tuple, got)) == [("p", "x.py", 1, 2, False), ("p", "y.py", 7, 7, False)]


def test_ignored(spark):
    files = [("p", "", "# comment\n*.log\n!keep.log\nbuild/\n/root.txt\ndocs/**/secret\nvendor/**\n\\#odd\n"), ("p", "sub", "keep.log\n!other.log\n*.t?p\n")]
    want = {
        "a.log": True, "keep.log": False, "deep/keep.log": False, "sub/keep.log": True, "sub/other.log": False, "other.log": True, "build/x.py": True, "deep/build/x.py": True, "build": False, "root.txt": True, "deep/root.txt": False,
        "docs/secret": True, "docs/a/b/secret": True, "vendor/x": True, "vendor": False, "#odd": True, "sub/a.tmp": True, "a.tmp": False, "build/keep.log": True, "app.py": False,
    }
    rules = changes.ignore_rules(spark.createDataFrame(files, "project string, dir string, source string"))
    got = changes.ignored(spark.createDataFrame([("p", x) for x in want] + [("q", "a.log")], "project string, path string"), rules).collect()
    assert {r["path"]: r["ignored"] for r in got if r["project"] == "p"} == want
    assert [r["ignored"] for r in got if r["project"] == "q"] == [False]


UNITS = [
    (".github/workflows/ci.yml", "on:\n  pull_request_target:\njobs:\n  x: ${{ github.event.pull_request.head.sha }}\n"),
    (".github/workflows/pr.yml", "on: [pull_request]\nenv:\n  A: ${{ secrets.DEPLOY_KEY }}\n  B: ${{ secrets.GITHUB_TOKEN }}\n"),
    ("requirements.txt", "-r base.txt\n# c\nrequests==1.0\nfoo @ git+https://x/y\n-e ./local\nhttps://x/y.whl\nbar @ https://x/z.whl # why\n"),
    ("key.json", '{"type": "service_account",\n "private_key": "' + "A" * 120 + '"}'),
    ("fake.json", '{"type": "service_account", "private_key": "short"}'),
    (".env.local", "API_KEY=abcdefghijklmnop1234\nOTHER=abcdefghijklmnop1234\nAPP_TOKEN=changeme\nDB_PASSWORD=$PASS_FROM_SOMEWHERE\nMY_SECRET=aaaaaaaaaaaaaaaa\n"),
    ("notes.md", "see https://bob:hunter22@host.example/x and https://bob:password@host\n"),
]


def test_project_text(spark):
    units = spark.createDataFrame([("p", p, "text", s) for p, s in UNITS], "project string, path string, file_type string, source string")
    got = sorted((r["file_path"], r["line"], r["rule_id"].split(".")[1]) for r in project_text.all_rules(units).collect())
    assert got == sorted([
        (".github/workflows/ci.yml", 2, "github-actions-pull-request-target"), (".github/workflows/pr.yml", 3, "github-actions-secrets-in-pr"),
        ("requirements.txt", 4, "dependency-git-reference"), ("requirements.txt", 5, "dependency-local-path"), ("requirements.txt", 6, "dependency-url-reference"), ("requirements.txt", 7, "dependency-url-reference"),
        ("key.json", 1, "gcp-service-account-key"), (".env.local", 1, "hardcoded-env-value"), ("notes.md", 1, "url-credentials"),
    ])
