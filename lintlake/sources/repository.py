"""A version-controlled repository as a data source: the files of a revision, the paths that a change touches, its patch.

``spark.dataSource.register(RepositorySource)`` makes ``spark.read.format("repository")``
with the options ``path`` (a repository that driver and executors reach), ``project``,
``revision`` and, for what changed since another revision, ``base``. Listing a revision
gives object names; they are dealt in ranges over tasks, and each task reads its own
objects from one process. Filters on ``path`` are pushed to the listing, so the
contents of other files are never read.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from lintlake.sources.changes import changed_regions
from lintlake.sources.corpus import file_type

#: Files that a task reads at most.
TASK_FILES = 500


class RepositoryError(ValueError):
    """A revision or repository that can't be read."""


def _run(repository: str, *arguments: str, text: str | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repository, *arguments], input=text.encode() if text is not None else None, capture_output=True)
    if done.returncode:
        raise RepositoryError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def resolve(repository: str, revision: str) -> str:
    """The commit that a revision names."""
    return _run(repository, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()


@dataclass(frozen=True)
class Objects(InputPartition):
    """Files of one task: (path, object)."""

    files: tuple[tuple[str, str], ...] = field(default=())


class RevisionReader(DataSourceReader):
    """Reads ``project, path, source`` of a revision's files, or of those that differ from ``base``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.repository, self.project = options["path"], options.get("project", "")
        self.revision = resolve(self.repository, options.get("revision", "HEAD"))
        self.base = resolve(self.repository, options["base"]) if options.get("base") else None
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the path hold for the listing already."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _is_wanted(self, path: str) -> bool:
        def holds(f: Filter) -> bool:
            match f:
                case EqualTo():
                    return path == f.value
                case In():
                    return path in f.value
                case StringStartsWith():
                    return path.startswith(f.value)
            return path.endswith(f.value)

        return all(map(holds, self.wanted))

    def _listed(self) -> Iterator[tuple[str, str]]:
        """(path, object) of the revision's files."""
        for line in _run(self.repository, "ls-tree", "-r", "-z", self.revision).decode(errors="replace").split("\0"):
            if line:
                about, path = line.split("\t", 1)
                mode, kind, name = about.split(" ")
                if kind == "blob" and mode != "120000":  # no links
                    yield path, name

    def partitions(self) -> list[Objects]:
        changed = None
        if self.base is not None:
            changed = set(_run(self.repository, "diff", "--name-only", "-z", "--no-renames", f"{self.base}...{self.revision}").decode(errors="replace").split("\0"))
        files = [(p, o) for p, o in self._listed() if (changed is None or p in changed) and self._is_wanted(p)]
        return [Objects(tuple(files[at : at + TASK_FILES])) for at in range(0, len(files), TASK_FILES)] or [Objects()]

    def read(self, partition: Objects) -> Iterator[tuple[str, str, str]]:
        if not partition.files:
            return
        data, at = _run(self.repository, "cat-file", "--batch", text="".join(f"{o}\n" for _, o in partition.files)), 0
        for path, _ in partition.files:  # contents come in the order asked
            end = data.index(b"\n", at)
            size = int(data[at:end].split(b" ")[2])
            body = data[end + 1 : end + 1 + size]
            at = end + size + 2
            if b"\0" not in body:  # no binaries
                yield self.project, path, body.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")


class RepositorySource(DataSource):
    """``format("repository")``."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "project string, path string, source string"

    def reader(self, schema: object) -> RevisionReader:
        return RevisionReader(self.options)


def units(spark: SparkSession, repository: str, revision: str = "HEAD", project: str = "", base: str | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """The units of a revision; with ``base`` those of files that changed since the two parted, below the folders of ``scope`` if any."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses sources that take filters without it
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format("repository").option("path", repository).option("revision", revision).option("project", project)
    rows = (reader.option("base", base) if base else reader).load()
    if scope:
        below = F.lit(False)
        for s in scope:
            below = below | (F.col("path") == s) | F.col("path").startswith(f"{s.rstrip('/')}/")
        rows = rows.where(below)
    return rows.withColumn("file_type", file_type(F.col("path"))).where("file_type is not null").select("project", "path", "file_type", "source")


def regions(spark: SparkSession, repository: str, base: str, revision: str = "HEAD", project: str = "") -> DataFrame:
    """The changed regions of a revision since it parted from ``base``: its patch as a table, cut by ``changed_regions``.

    Each file's patch is a row of its own, so no task gets a whole patch.
    """
    patch = _run(repository, "diff", "--unified=0", "--no-color", "--no-ext-diff", "--no-renames", f"{resolve(repository, base)}...{resolve(repository, revision)}").decode(errors="replace")
    pieces = [f"diff --git {p}" for p in f"\n{patch}".split("\ndiff --git ")[1:]]
    rows = spark.createDataFrame([(project, i, p) for i, p in enumerate(pieces)], "project string, piece int, patch string")
    cut = changed_regions(rows.select(F.concat_ws("\u0001", "project", F.col("piece").cast("string")).alias("project"), "patch"))
    return cut.withColumn("project", F.substring_index("project", "\u0001", 1))
