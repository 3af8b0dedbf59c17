"""Joins: ranges by bucket, containment, resolution with fallbacks, two-hop adjacency, typed chains, orphans and differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import similar_in_blocks  # noqa: F401  a join, and what projections fall back to
from .lookup import first_by


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """All pairs with start <= at <= end and equal keys. Ranges are cut into buckets of `width`, so the join is by equality and a
    long range costs one row per bucket; each pair is found once, since a point is in one bucket."""
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return placed.join(cut, [*keys, "_bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_bucket")


def best_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, ident: str) -> DataFrame:
    """The range that fits a point best: one that starts at it first, then the later start, then the greatest id."""
    found = range_join(points, ranges, keys, at, start, end)
    order = [F.when(F.col(start) == F.col(at), 0).otherwise(1), F.desc(start), F.desc(ident)]
    return first_by(found, [*keys, at], order)


def innermost(spans: DataFrame, holders: DataFrame, key: str) -> DataFrame:
    """For spans (key, ref, s, e) the smallest holder (key, holder, hs, he) that contains them; the least holder of equals."""
    inside = range_join(spans, holders, [key], "s", "hs", "he", 1024).where("e <= he")
    return first_by(inside, [key, "ref"], [F.col("he") - F.col("hs"), F.col("holder")])


def resolve_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (call, file, name) to symbols (id, file, name, fqn): by name in the same file, else by fqn, else by name anywhere; the
    least id of several, null if none fits."""
    local = symbols.groupBy("file", "name").agg(F.min("id").alias("local_id"))
    full = symbols.groupBy(F.col("fqn").alias("name")).agg(F.min("id").alias("fqn_id"))
    simple = symbols.groupBy("name").agg(F.min("id").alias("any_id"))
    found = calls.join(local, ["file", "name"], "left").join(full, "name", "left").join(simple, "name", "left")
    how = F.when(F.col("local_id").isNotNull(), "file").when(F.col("fqn_id").isNotNull(), "fqn").when(F.col("any_id").isNotNull(), "name")
    return found.select("call", "file", "name", F.coalesce("local_id", "fqn_id", "any_id").alias("target"), how.alias("how"))


def resolve_unique(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls joined to symbols by name where exactly one symbol has the name."""
    only = symbols.groupBy("name").agg(F.min("id").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    return calls.join(only, "name")


def resolve_qualified(names: DataFrame, symbols: DataFrame, separator: str = "::") -> DataFrame:
    """Qualified names (name, file) to symbols (id, name, fqn, file): the whole name as fqn, then without a leading crate or super,
    then its last part, in the same file first; the least id of equals."""
    cut = F.regexp_replace("wanted", f"^((crate|super|self){separator})+", "")
    last = F.element_at(F.split("wanted", separator), -1)
    asked = names.select(F.col("name").alias("wanted"), F.col("file").alias("from_file"))
    tried = ((0, F.col("wanted"), True), (1, cut, True), (2, last, True), (2, last, False))
    keyed = asked.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), k.alias("key"), F.lit(full).alias("full")) for i, k, full in tried))).alias("k")).select("wanted", "from_file", "k.*")
    by_key = symbols.select("id", F.col("file").alias("from_file"), F.explode(F.array(*(F.struct(F.col(c).alias("key"), F.lit(c == "fqn").alias("full")) for c in ("fqn", "name")))).alias("s"))
    # one row per key and file, and one per key: a name that many ask for and many have is no product of the two
    local = by_key.groupBy("s.key", "s.full", "from_file").agg(F.min("id").alias("local_id"))
    anywhere = by_key.groupBy("s.key", "s.full").agg(F.min("id").alias("any_id"))
    found = keyed.join(anywhere, ["key", "full"]).join(local, ["key", "full", "from_file"], "left")
    best = F.struct("rank", F.col("local_id").isNull().alias("far"), F.coalesce("local_id", "any_id").alias("id"))
    chosen = found.groupBy("wanted", "from_file").agg(F.min(best).alias("best"))
    return chosen.select(F.col("wanted").alias("name"), F.col("from_file").alias("file"), F.col("best.id").alias("target"))


def call_pairs(edges: DataFrame) -> DataFrame:
    """Symbol to symbol calls from reified ones: Symbol -CALLER-> Call -CALLS-> Symbol."""
    out = edges.where("edge_type = 'CALLER'").select(F.col("from_id").alias("caller"), F.col("to_id").alias("call"))
    into = edges.where("edge_type = 'CALLS'").select(F.col("from_id").alias("call"), F.col("to_id").alias("callee"))
    return out.join(into, "call")


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """Outgoing, then incoming edges of a node: direction, edge_type, other."""
    out = edges.where(F.col("from_id") == node).select(F.lit("out").alias("direction"), "edge_type", F.col("to_id").alias("other"))
    into = edges.where(F.col("to_id") == node).select(F.lit("in").alias("direction"), "edge_type", F.col("from_id").alias("other"))
    return out.unionByName(into)


def chain(edges: DataFrame, seeds: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Nodes (node) reached from seeds (node) by typed hops, each ('>', type) forward or ('<', type) backward."""
    at = seeds.select("node")
    for way, kind in steps:
        here, there = ("from_id", "to_id") if way == ">" else ("to_id", "from_id")
        hop = edges.where(F.col("edge_type") == kind).select(F.col(here).alias("node"), F.col(there).alias("_next"))
        at = at.join(hop, "node").select(F.col("_next").alias("node")).distinct()
    return at


def pattern(edges: DataFrame, nodes: DataFrame, legs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Paths n0, n1, ... where each leg is (kind of the node it leaves, edge type, kind of the node it reaches)."""
    kinds = nodes.select(F.col("id").alias("_id"), F.col("kind").alias("_kind"))
    of = lambda column, kind: kinds.where(F.col("_kind") == kind).select(F.col("_id").alias(column))
    found = of("n0", legs[0][0])
    for i, (_, edge, kind) in enumerate(legs):
        hop = edges.where(F.col("edge_type") == edge).select(F.col("from_id").alias(f"n{i}"), F.col("to_id").alias(f"n{i + 1}"))
        found = found.join(hop, f"n{i}").join(of(f"n{i + 1}", kind), f"n{i + 1}")
    return found.select(*(f"n{i}" for i in range(len(legs) + 1)))


def orphans(references: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Reference nodes without a REFERENCES edge and Call nodes without a CALLER or a CALLS edge: id, problem. Edges are read once and
    come to one row per node and type before the join."""
    wanted = ((references, "REFERENCES", "no target"), (calls, "CALLER", "no caller"), (calls, "CALLS", "no callee"))
    needed = reduce(DataFrame.unionByName, (rows.select("id", F.lit(kind).alias("edge_type"), F.lit(problem).alias("problem")) for rows, kind, problem in wanted))
    end = F.when(F.col("edge_type") == "CALLER", F.col("to_id")).otherwise(F.col("from_id"))
    there = edges.where(F.col("edge_type").isin([kind for _, kind, _ in wanted])).select(end.alias("id"), "edge_type").distinct()
    return needed.join(there, ["id", "edge_type"], "left_anti").select("id", "problem")


def compared(expected: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full-outer difference of two tables by key: status ok, changed, missing (not in current) or extra (not in expected)."""
    one = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    two = current.select(*keys, F.col(value).alias("current"), F.lit(True).alias("_c"))
    status = (
        F.when(F.col("_c").isNull(), "missing").when(F.col("_e").isNull(), "extra")
        .when(F.col("expected").eqNullSafe(F.col("current")), "ok").otherwise("changed")
    )
    return one.join(two, list(keys), "full_outer").select(*keys, "expected", "current", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of old, and those of new whose key old doesn't have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of numbers, by built-in array functions; 0 if one is zero."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)
