"""Paths resolved to stored files in five stages, and cross-references between projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lookup import normal_path


def _normal(path: Column) -> Column:
    """The path without empty, . and .. parts; an absolute one stays absolute."""
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), normal_path(path))


def resolve_paths(files: DataFrame, queries: DataFrame, root: str | None = None, folder: str = "/") -> DataFrame:
    """(query, id, stage) of queries (query) that name one of files (id, path), by the first stage that holds:

    1 as given; 2 a relative one below `root`; 3 an absolute one less `root`; 4 joined to the working folder; 5 by suffix: a
    relative query ends one stored path at a part, or an absolute query ends with one relative stored path. Several stored
    paths at stage 5 give nothing, and so does a query that no stage finds. Of files with one path the least id counts.

    Every stage is an equality join; suffixes are the stored paths' and the queries' own tails, one row per part.
    """
    stored = files.groupBy(_normal(F.col("path")).alias("key")).agg(F.min("id").alias("id"))
    asked = queries.select("query").where("query is not null").distinct().withColumn("q", _normal(F.col("query")))
    absolute = F.col("query").startswith("/")
    base, here = (root or "").rstrip("/"), folder.rstrip("/")
    keys = [F.struct(F.lit(1).alias("stage"), F.col("q").alias("key"))]
    if root:
        keys.append(F.struct(F.lit(2).alias("stage"), F.when(~absolute, _normal(F.concat(F.lit(base + "/"), "q"))).alias("key")))
        keys.append(F.struct(F.lit(3).alias("stage"), F.when(absolute & F.col("q").startswith(base + "/"), F.expr(f"substring(q, {len(base) + 2})")).alias("key")))
    keys.append(F.struct(F.lit(4).alias("stage"), F.when(~absolute, _normal(F.concat(F.lit(here + "/"), "q"))).alias("key")))
    direct = asked.select("query", F.explode(F.array(*keys)).alias("k")).select("query", "k.*").where("key is not null and key <> ''").join(stored, "key")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), n, F.size(F.split(c, "/"))), "/"))
    relative = asked.where(~absolute & (F.col("q") != "")).select("query", F.col("q").alias("tail"))
    ends = stored.select("id", F.explode(tails(F.col("key"))).alias("tail")).join(relative, "tail").select("query", "id")
    # a whole absolute query is no relative path, so its own tail without the leading / counts as well
    longer = asked.where(absolute).select("query", F.explode(tails(F.expr("substring(q, 2)"))).alias("key"))
    ends = ends.unionByName(longer.join(stored.where(~F.col("key").startswith("/")), "key").select("query", "id")).where("id is not null")
    only = ends.groupBy("query").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1").select("query", F.lit(5).alias("stage"), "id")
    every = direct.select("query", "stage", "id").unionByName(only)
    return every.groupBy("query").agg(F.min_by("id", "stage").alias("id"), F.min("stage").alias("stage"))


def cross_references(pairs: DataFrame) -> DataFrame:
    """Similar pairs (a, b, cosine) of symbols as rows for either of them: symbol, other, score."""
    one = pairs.select(F.col("a").alias("symbol"), F.col("b").alias("other"), F.col("cosine").alias("score"))
    return one.unionByName(pairs.select(F.col("b").alias("symbol"), F.col("a").alias("other"), F.col("cosine").alias("score")))


def analogues(references: DataFrame, symbols: DataFrame, asked: DataFrame, project: str | None = None, limit: int | None = None) -> DataFrame:
    """(symbol, other, project, name, score, place) of the asked symbols (symbol): their references, best score first, ties by id, into
    one project if named, the first `limit` of each if given. symbols are (id, project, name)."""
    of = symbols.select(F.col("id").alias("other"), "project", "name")
    rows = references.join(asked.select("symbol").distinct(), "symbol").join(of if project is None else of.where(F.col("project") == project), "other")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "other")))
    return (rows if limit is None else rows.where(F.col("place") <= limit)).select("symbol", "other", "project", "name", "score", "place")


def compared_projects(references: DataFrame, symbols: DataFrame, name: str, projects: list) -> DataFrame:
    """(project, id, others, best) of the symbols with a name in some projects: the least id of each project, in how many other of
    these projects symbols of that name exist, and the best score of a reference from it into them; null without one."""
    named = symbols.where((F.col("name") == name) & F.col("project").isin(*projects))
    first = named.groupBy("project").agg(F.min("id").alias("id"))
    total = first.agg((F.count("*") - 1).alias("others"))
    into = symbols.where(F.col("project").isin(*projects)).select(F.col("id").alias("other"), F.col("project").alias("to_project"))
    best = references.join(first.select(F.col("id").alias("symbol"), "project"), "symbol").join(into, "other").where("to_project <> project").groupBy("project").agg(F.max("score").alias("best"))
    return first.join(best, "project", "left").crossJoin(F.broadcast(total)).select("project", "id", "others", "best")  # one row


def file_imports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, symbols, imports) of each file of symbols (file, ...): how many it has, and what it imports (file, path array), sorted and
    each once; a file's own imports are the list's bound."""
    listed = imports.groupBy("file").agg(F.sort_array(F.collect_set(F.array_join("path", "::"))).alias("imports"))
    return symbols.groupBy("file").agg(F.count("*").alias("symbols")).join(listed, "file", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))

