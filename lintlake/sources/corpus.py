"""Source units as a table: from text tables, from a source tree, or planted from ``part`` rows.

Every unit is a row ``project, path, file_type, source``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File kinds that are read, and folders and lock files that are not.
TEXT_SUFFIXES = ("cfg", "env", "ini", "json", "md", "toml", "txt", "yaml", "yml")
IGNORED_FOLDERS = (
    ".fleet", ".git", ".hg", ".idea", ".mypy_cache", ".pyre", ".pytest_cache", ".pytype", ".ruff_cache", ".svn", ".tox", ".venv", ".vscode", "__pycache__",
    "build", "cache", "coverage", "dist", "generated", "htmlcov", "node_modules", "tmp", "vendor", "venv",
)
LOCK_FILES = ("uv.lock", "poetry.lock", "Pipfile.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Cargo.lock", "go.sum")


def file_type(path: Column) -> Column:
    """python, text or null for files that are not read."""
    name = F.element_at(F.split(path, "/"), -1)
    text = F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*TEXT_SUFFIXES) | name.startswith(".env") | name.rlike(r"^requirements.*\.(txt|in)$") | (name == "setup.cfg")
    return F.when(name.isin(*LOCK_FILES), None).when(name.endswith(".py"), "python").when(text, "text")


def ignored_by(path: Column, patterns: tuple[str, ...] = (), include_ignored: bool = False) -> Column:
    """Why a path is left out: a configured pattern, a default folder, or null. Configuration holds even with ``include_ignored``."""
    out = F.lit(None).cast("string")
    if not include_ignored:
        folders = "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS)
        out = F.when(path.rlike(rf"(^|/)({folders})/"), "default")
    for p in patterns:
        out = F.when(path.rlike(glob_regex(p)), "config").otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ** crosses folders, * and ? don't; a plain path also covers what is below it."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return f"^{out}$" if any(c in pattern for c in "*?") else f"^{out}(/.*)?$"


def read_tree(spark: SparkSession, root: str, project: str, patterns: tuple[str, ...] = (), include_ignored: bool = False, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The units of a folder, line ends as line feeds; paths are relative to it.

    Spark lists no folders whose name begins with a dot: ``hidden`` names those to read.
    """
    files = spark.read.text([root, *(f"{root}/{h}" for h in hidden)], wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("full"))
    path = F.regexp_replace(F.col("full"), rf"^.*?{root.rstrip('/')}/", "")
    units = files.select(F.lit(project).alias("project"), path.alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("source"))
    kept = units.where(ignored_by(F.col("path"), patterns, include_ignored).isNull()).withColumn("file_type", file_type(F.col("path")))
    return kept.where("file_type is not null").select("project", "path", "file_type", "source")


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents as text units."""
    return documents.select(F.col("source").alias("project"), F.concat(F.lit("tests/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("text").alias("file_type"), F.coalesce("text", F.lit("")).alias("source"))


def _lines(*parts: Column) -> Column:
    """Lines joined by line feeds; null ones are left out."""
    return F.concat_ws("\n", *parts)


def planted(parts: DataFrame) -> DataFrame:
    """A Python module for each part: its size sets parameters and branches, its key what else is in it."""
    k, size = F.col("p_partkey"), F.col("p_size")
    key = k.cast("string")
    every = lambda n, text: F.when(k % n == 0, text if isinstance(text, Column) else F.lit(text))
    names = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat(F.lit("arg"), i.cast("string")))
    branches = F.concat_ws("\n", F.transform(names, lambda a: F.concat(F.lit("    if "), a, F.lit(":\n        total = total + 1"))))
    nested = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), size % 9 + 1), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("while total:"))))
    source = _lines(
        every(4, '"""A module."""'),
        F.lit("import os\nimport sys as system"),
        every(6, "import pickle"),
        every(7, F.concat(F.lit('ACCESS = "AKIA'), F.lpad(key, 16, "0"), F.lit('"'))),
        every(13, F.concat(F.lit('URL = "postgres://app:pw'), key, F.lit('@db.example.org/x"'))),
        every(14, F.concat(F.lit('TOKEN = "eyJ'), F.lpad(key, 10, "a"), F.lit("."), F.lpad(key, 12, "b"), F.lit("."), F.lpad(key, 12, "c"), F.lit('"'))),
        every(16, "# -----BEGIN RSA PRIVATE KEY-----"),
        every(17, F.concat(F.lit("# patient 321-54-"), F.lpad((k % 10_000).cast("string"), 4, "0"))),
        every(18, F.concat(F.lit('HOOK = "ghp_'), F.lpad(key, 36, "d"), F.lit('"'))),
        every(9, F.lit("# TODO one\n# FIXME two")),
        F.lit("\n"),
        F.concat(F.lit("class Item"), key, F.lit(":")),
        every(3, '    """An item."""'),
        F.concat_ws("\n", F.transform(F.sequence(F.lit(0), size % 14), lambda i: F.concat(F.lit("    def method_"), i.cast("string"), F.lit("(self):\n        return os.sep")))),
        F.lit("\n"),
        F.concat(F.lit("def work_"), key, F.lit("("), F.concat_ws(", ", names), F.lit("):")),
        every(5, '    """Work."""'),
        F.lit("    total = 0"),
        every(8, "    q = total"),
        every(10, "    tmp_value = total"),
        branches,
        every(11, "    eval('total')"),
        F.lit("    return total"),
        every(12, "    total = 1"),
        F.lit("\n"),
        F.concat(F.lit("def _deep_"), key, F.lit("(total):")),
        nested,
        F.concat(F.repeat(F.lit("    "), size % 9 + 2), F.lit("total = 0")),
        F.lit("\n"),
        F.concat(F.lit("def caller_"), key, F.lit("():\n    return work_"), (k + 1).cast("string")),
        F.lit(""),
    )
    return parts.select(F.concat(F.lit("p"), (k % 5).cast("string")).alias("project"), F.concat(F.lit("pkg/part_"), key, F.lit(".py")).alias("path"), F.lit("python").alias("file_type"), source.alias("source"))


def planted_tests(customers: DataFrame) -> DataFrame:
    """A Python test module for each customer: its key sets which habits it shows."""
    k = F.col("c_custkey")
    key = k.cast("string")
    every = lambda n, text: F.when(k % n == 0, F.lit(text))
    source = _lines(
        F.lit("import os\nimport pickle\nimport ssl\nimport subprocess\nimport time\n"),
        F.concat(F.lit("def test_case_"), key, F.lit("(fixture):")),
        F.lit("    total = fixture"),
        every(2, "    time.sleep(1)"),
        every(3, "    assert True"),
        every(4, "    assert not 1"),
        every(5, "    assert 'text'"),
        every(6, '    total = "{}".format(total)'),
        every(7, "    try:\n        total = 1\n    except Exception:\n        pass"),
        every(8, "    subprocess.run(total, shell=True)"),
        every(9, "    os.system(total)"),
        every(10, "    total = ssl.PROTOCOL_TLSv1"),
        every(11, "    global state\n    state = 1"),
        every(12, "    total = pickle.loads(total)"),
        every(13, "    assert total == 1"),
        F.lit("    return total\n\n"),
        F.concat(F.lit("def helper_"), key, F.lit("(used, spare, _kept):\n    return used\n\n")),
        F.concat(F.lit("def empty_"), key, F.lit("():\n"), F.when(k % 2 == 0, '    """Nothing."""').otherwise("    pass"), F.lit("\n\n")),
        F.concat(F.lit("class "), F.when(k % 5 == 0, F.lit("Manager")).otherwise(F.concat(F.lit("Holder"), key)), F.lit(":\n    value = 1\n\n    def __init__(self):\n        self.left = 1\n        self.right = 2\n        self.left = 3\n")),
    )
    return customers.select(F.concat(F.lit("p"), (k % 5).cast("string")).alias("project"), F.concat(F.lit("tests/test_"), key, F.lit(".py")).alias("path"), F.lit("python").alias("file_type"), source.alias("source"))
