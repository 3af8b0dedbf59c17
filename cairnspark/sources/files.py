"""Source trees as DataFrames: files with the reason why one is skipped, documents with their metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.lookup import glob_pattern
from ..operators.metrics import numbered

#: Folders that are never indexed (fixed values).
INTERNAL = (".git", "target", "node_modules", ".venv", "venv", "__pycache__")
#: Ends of files that are never indexed (fixed values).
INTERNAL_ENDS = (".db", ".db-journal", ".db-wal", ".db-shm", ".sqlite", ".sqlite3")


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content (text), size and hash of every file under a folder; Spark lists and reads them in parallel."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.md5("content").alias("hash"), "modificationTime")


def skip_reason(path: Column, ignored: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Why a path isn't indexed, by the first test that holds: internal folder or file, ignore glob, unknown language, not included,
    excluded; null for paths that are."""
    any_of = lambda globs: F.coalesce(*[F.when(path.rlike(glob_pattern(g)), True) for g in globs], F.lit(False)) if globs else F.lit(False)
    inside = F.exists(F.split(path, "/"), lambda s: s.isin(*INTERNAL))
    for end in INTERNAL_ENDS:
        inside = inside | path.endswith(end)
    return (
        F.when(inside, "internal").when(any_of(ignored), "ignored").when(X.language_of(path).isNull(), "unsupported")
        .when(F.lit(bool(include)) & ~any_of(include), "not included").when(any_of(exclude), "excluded")
    )


def documents(rows: DataFrame) -> DataFrame:
    """Markdown documents (path, content) with title, tags, wikilinks and hash."""
    text = F.col("content")
    return rows.select("path", X.title(text).alias("title"), X.tags(text).alias("tags"), X.wikilinks(text).alias("wikilinks"), F.md5(text).alias("hash"))


def selected_commits(commits: DataFrame, since: int | None = None, until: int | None = None, merges_only: bool = False, every: int = 1) -> DataFrame:
    """Commits (oid, time, n_parents) in a span of time, optionally only merges, and of those every n-th from the oldest on."""
    for keep, on in ((F.col("time") >= since, since), (F.col("time") <= until, until)):
        commits = commits if on is None else commits.where(keep)
    commits = commits.where("n_parents > 1") if merges_only else commits
    return numbered(commits, [F.col("time"), F.col("oid")], "_nth").where(F.expr(f"(_nth - 1) % {every} = 0")).drop("_nth")
