"""Ignore files of a tree: ordered patterns with negation, anchors and folder-only rules, joined to paths by ancestor folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pattern_regex(pattern: Column) -> Column:
    """A pattern (without ! and the slash at its end) as an expression on the path below its folder. With a slash at its start or
    inside it fits from the folder on, else the last part at any depth; * and ? stay inside a part, ** spans parts."""
    bare = F.regexp_replace(pattern, "^/", "")
    anchored = pattern.contains("/")
    quoted = F.regexp_replace(bare, r"([.+^$(){}|])", r"\\$1")
    # a negated class is [!...]; the class itself never takes a slash
    quoted = F.regexp_replace(quoted, r"\[!", "[^/")
    steps = (
        (r"^\*\*/", "\u0001"), (r"/\*\*/", "/\u0001"), (r"/\*\*$", "/\u0002"), (r"\*+", "\u0003"), (r"\?", "[^/]"),
        ("\u0001", "(?:.*/)?"), ("\u0002", ".+"), ("\u0003", "[^/]*"),
    )
    for old, new in steps:
        quoted = F.regexp_replace(quoted, old, new)
    return F.concat(F.when(anchored, "(?s)^").otherwise("(?s)^(?:.*/)?"), quoted, F.lit("$"))


def rules(files: DataFrame) -> DataFrame:
    """Rules (folder, rank, keeps, folders_only, regex) of ignore files (folder, rank, content): folder is "" at the root, of files
    in one folder the one of greater rank comes last. Blank lines and lines from # on are none; \\# and \\! stand for themselves."""
    lines = files.select("folder", "rank", F.posexplode(F.split("content", r"\r?\n")).alias("line", "spelled"))
    text = F.rtrim("spelled")
    rows = lines.select("folder", F.struct("rank", "line").alias("rank"), text.alias("t")).where("t <> '' and t not like '#%'")
    keeps, bare = F.col("t").startswith("!"), F.regexp_replace(F.regexp_replace("t", "^!", ""), r"^\\([#!])", "$1")
    ends = bare.endswith("/")
    pattern = F.regexp_replace(bare, "/$", "")
    return rows.select("folder", "rank", keeps.alias("keeps"), ends.alias("folders_only"), pattern_regex(pattern).alias("regex")).where("regex <> '(?s)^$'")


def ignored(paths: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Paths (path, relative to the root, unique) that ignore files leave out: (path, by), by being the file or folder that is.

    A path and each folder above it are looked at; for each of them the last rule that fits decides, rules of deeper folders after
    those of upper ones. A path in a folder that is left out is left out, whatever its own rules say. Each of them meets only the
    rules of the folders it lies in, by equality.
    """
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("entity"), (n < F.size(parts)).alias("is_folder")))
    entities = paths.select(F.explode(upto).alias("e")).select("e.*").distinct()
    above = F.split("entity", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda n: F.struct(F.array_join(F.slice(above, F.lit(1), n), "/").alias("folder"), F.array_join(F.slice(above, n + 1, F.size(above)), "/").alias("below"), n.alias("depth")))
    met = entities.select("entity", "is_folder", F.explode(folders).alias("f")).select("entity", "is_folder", "f.*").join(rule_table, "folder")
    fits = met.where((F.col("is_folder") | ~F.col("folders_only")) & F.expr("below rlike regex"))
    last = fits.groupBy("entity", "is_folder").agg(F.max_by("keeps", F.struct("depth", "rank")).alias("keeps")).where("not keeps").drop("keeps")
    own = paths.select("path", F.explode(upto).alias("e")).select("path", "e.*")
    return own.join(last, ["entity", "is_folder"]).groupBy("path").agg(F.min("entity").alias("by"))
