"""Projections, filters and lookups over symbols, labels, chunks, trees and logs. Each takes and returns DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def symbols_in_file(files: DataFrame, defines: DataFrame, symbols: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """Symbols that the file at `path` defines, optionally of one kind; files(id, path), defines(from_id, to_id)."""
    of = files.where(F.col("path") == path).select(F.col("id").alias("from_id"))
    found = symbols.join(defines.join(of, "from_id", "left_semi").select(F.col("to_id").alias("id")), "id", "left_semi")
    return found if kind is None else found.where(F.col("kind") == kind)


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a full order: where several match, one is chosen the same way each time."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def by_prefix(symbols: DataFrame, prefix: str) -> DataFrame:
    """Names that start with a prefix in either case; % and _ of the prefix stand for themselves."""
    return symbols.where(F.lower("name").startswith(prefix.lower()))


def glob_pattern(glob: str) -> str:
    """A glob (* and ?) as a regular expression for whole names."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def by_glob(symbols: DataFrame, glob: str) -> DataFrame:
    return symbols.where(F.col("name").rlike("(?s)" + glob_pattern(glob)))


def relevance(name: Column, term: str, path: Column, kind: Column, public: Column, test: Column) -> Column:
    """How well a symbol answers a search for a term. The weights are fixed values: exact 100 or contained 10, public 50, outside
    tests 30, 20 shared over the path's depth, callable or class 10, module 5, method 0, others 2."""
    depth = F.size(F.split(path, "/"))
    by_kind = F.when(kind.isin("Function", "Class"), 10).when(kind == "Module", 5).when(kind == "Method", 0).otherwise(2)
    match = F.when(name == term, 100).when(name.contains(term), 10).otherwise(0)
    return match + F.when(public, 50).otherwise(0) + F.when(~test, 30).otherwise(0) + F.floor(F.lit(20) / depth) + by_kind


def resolve(symbols: DataFrame, key: str, columns: Sequence[str] = ("symbol_id", "fqn", "display_fqn", "canonical_fqn")) -> DataFrame:
    """The symbol whose id is the key, else the one that has it as a name of any sort; the least id of several."""
    rank = reduce(lambda acc, c: F.when(F.col(c[1]) == key, 0 if c[0] == 0 else 1).otherwise(acc), reversed(list(enumerate(columns))), F.lit(None))
    return symbols.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


def with_label(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col("label") == label).select("entity_id").distinct()


def with_all_labels(labels: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Entities that have every label: relational division."""
    n = len(set(wanted))
    found = labels.where(F.col("label").isin(*wanted)).groupBy("entity_id").agg(F.countDistinct("label").alias("n"))
    return found.where(F.col("n") == n).select("entity_id")


def chunks(
    rows: DataFrame, path_part: str | None = None, kind: str | None = None, least: int | None = None, limit: int | None = None,
    symbol: str | None = None, span: tuple[str, int, int] | None = None,
) -> DataFrame:
    """Chunks by optional predicates in order of file and place: a part of the path, kind, least size, the symbol's name, and the
    span (file, byte_start, byte_end) that a chunk covers exactly."""
    wanted = []
    if symbol is not None:
        wanted.append(F.col("symbol_name") == symbol)
    if span is not None:
        wanted.append((F.col("file_path") == span[0]) & (F.col("byte_start") == span[1]) & (F.col("byte_end") == span[2]))
    if path_part is not None:
        wanted.append(F.col("file_path").contains(path_part))
    if kind is not None:
        wanted.append(F.col("kind") == kind)
    if least is not None:
        wanted.append(F.col("byte_end") - F.col("byte_start") >= least)
    found = reduce(lambda df, p: df.where(p), wanted, rows).orderBy("file_path", "byte_start")
    return found if limit is None else found.limit(limit)


def node_at(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """For positions (file, pos): the smallest node (file, node, byte_start, byte_end) with byte_start <= pos < byte_end."""
    from .joins import range_join

    inside = range_join(positions, nodes, ["file"], "pos", "byte_start", "byte_end", 1024).where("pos < byte_end")
    return first_by(inside, ["file", "pos"], [F.col("byte_end") - F.col("byte_start"), F.col("node")])


def is_live(condition: Column, features: Sequence[str]) -> Column:
    """Whether code under a flat feature condition is built: none, feature = "x", all(...), any(...), not(...); else true."""
    names = F.regexp_extract_all(condition, F.lit('feature *= *"([^"]*)"'), 1)
    on = lambda x: x.isin(*features) if features else F.lit(False)
    head = F.regexp_extract(F.trim(condition), r"^(all|any|not)\s*\(", 1)
    return (
        F.when(condition.isNull() | (F.trim(condition) == ""), True)
        .when(F.size(names) == 0, True)
        .when(head == "any", F.exists(names, on))
        .when(head == "not", ~F.exists(names, on))
        .otherwise(F.forall(names, on))
    )


def context_lines(text: Column, line: Column, around: int) -> Column:
    """The lines from `around` before to `around` after a line (from 1)."""
    lines = F.split(text, "\n")
    start = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(lines, start.cast("int"), (line + around - start + 1).cast("int")), "\n")


def latest(rows: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The newest rows first; `order` must break all ties."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(limit)


def phase_durations(events: DataFrame, start: str, end: str) -> DataFrame:
    """For each end event of a run the seconds since its latest start; events (run, kind, at, id)."""
    w = Window.partitionBy("run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("kind") == start, F.col("at")), ignorenulls=True).over(w)
    return events.withColumn("began", began).where((F.col("kind") == end) & F.col("began").isNotNull()).withColumn("duration", F.col("at") - F.col("began"))


def suffix_matches(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (query) resolved to the one path (path) that ends with them at a segment; ambiguous queries give nothing."""
    depth = F.sequence(F.lit(1), F.size("segments"))
    tails = paths.select("path", F.split("path", "/").alias("segments")).select(
        "path", F.explode(F.transform(depth, lambda k: F.array_join(F.slice("segments", F.size("segments") - k + 1, k), "/"))).alias("query")
    )
    hits = queries.join(tails, "query").groupBy("query").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n"))
    return hits.where("n = 1").select("query", "path")


def normal_path(path: Column) -> Column:
    """A relative path without empty and . segments, and with .. resolved; .. above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def climbs(path: Column) -> Column:
    """Whether a path leaves its root at any point."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    level = lambda acc, s: F.struct(
        (acc["d"] + F.when(s == "..", -1).otherwise(1)).alias("d"), F.least(acc["low"], acc["d"] + F.when(s == "..", -1).otherwise(1)).alias("low")
    )
    return F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), level)["low"] < 0


def cursor_page(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of a full order with its total, page count and cursor of the next page (null on the last).

    The page is cut from the least page * size rows, so the whole table is never ordered in one task.
    """
    total = rows.agg(F.count("*").alias("total"))
    head = rows.orderBy(*order).limit(page * size)
    w = Window.orderBy(*order)
    cut = head.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") > (page - 1) * size)
    pages = F.ceil(F.col("total") / size).cast("long")
    more = F.when(pages > page, F.base64(F.lit(f"page={page + 1}").cast("binary")))
    return cut.crossJoin(F.broadcast(total)).withColumns({"pages": pages, "next": more})
