"""Bounded path enumeration, searches that spread over calls, and details of symbols with their surroundings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.search import prefix_hits
from ..plans.storage import drop_table, table
from .traversal import flipped


def enumerate_paths(edges: DataFrame, start: DataFrame, max_depth: int, max_paths: int, exits: DataFrame | None = None, visits: int = 1) -> tuple[DataFrame, DataFrame]:
    """Paths (path, length in nodes) from start (node), and one row of statistics.

    A path ends at an exit (node) if exits are given, else where nothing is called; it has two nodes at least. Paths that reach
    `max_depth` nodes are given up, which counts as the bound being hit, and so are those that would visit a node more than
    `visits` times, which doesn't. The shortest `max_paths` are kept, ties by path; the others are only counted. Statistics:
    total, kept, average, least and greatest length of those kept, their different nodes, bound_hit. Each round is a table, and
    only the round in which the limit is reached is cut, by its least paths.
    """
    out = table(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct(), "steps")
    paths = table(start.select(F.array("node").alias("path")), "paths")
    kept, total, pruned, left = [], 0, 0, max_paths
    for depth in range(1, max_depth + 1):
        if depth == max_depth:
            pruned = paths.count()
            break
        ends = paths.withColumn("at", F.element_at("path", -1))
        if depth > 1:
            of_exit = exits.select(F.col("node").alias("at")).distinct() if exits is not None else out.select("at").distinct()
            done = table(ends.join(of_exit, "at", "left_semi" if exits is not None else "left_anti").select("path"), "found")
            n = done.count()
            total += n
            if n and left:
                kept.append(done if n <= left else done.orderBy("path").limit(left))
                left = max(0, left - n)
            ends = ends.join(of_exit, "at", "left_anti") if exits is not None else ends
        seen = F.size(F.filter("path", lambda x: x == F.col("next")))
        grown = ends.join(out, "at").where(seen < visits).select(F.concat("path", F.array("next")).alias("path"))
        following = table(grown, "paths")
        drop_table(paths)
        paths = following
        if paths.isEmpty():
            break
    found = reduce(DataFrame.unionByName, kept) if kept else paths.limit(0)
    found = found.select("path", F.size("path").cast("long").alias("length"))
    sums = found.agg(
        F.lit(total).cast("long").alias("total"), F.count("*").alias("kept"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"),
        F.coalesce(F.min("length"), F.lit(0)).alias("least"), F.coalesce(F.max("length"), F.lit(0)).alias("greatest"), F.lit(pruned > 0).alias("bound_hit"),
    )
    nodes = found.select(F.explode("path").alias("node")).agg(F.countDistinct("node").alias("nodes"))
    return found, sums.crossJoin(F.broadcast(nodes))  # one row each


def hop_search(symbols: DataFrame, edges: DataFrame, text: str, k: int, hops: int, decay: float = 0.7) -> DataFrame:
    """(id, name, score, distance) of the symbols (id, name) that a text finds by prefix, and of those that call them or are called by
    them over up to `hops` calls: k + max(hops * k / 2, 5) rows at most, best first, ties by id.

    A seed keeps its own score; another symbol has the best of a seed's score times `decay` per call, either way but not both. A
    round only goes on from symbols whose neighbours can still be among the best: the score of the last row so far is the bound.
    """
    seeds = table(prefix_hits(symbols, text, k if hops else (k + 1) // 2).select(F.col("id").alias("node"), "score").orderBy(F.desc("score"), "node").limit(2 * k if hops else k), "seeds")
    most = k + max(hops * k // 2, 5) if hops else k
    found = seeds.withColumn("distance", F.lit(0).cast("long"))
    for way in (edges, flipped(edges)):
        steps = way.select(F.col("src").alias("node"), "dst")
        level = seeds
        for hop in range(1, hops + 1):
            reached = level.join(steps, "node").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * decay).alias("score"))
            level = table(reached.join(seeds.select("node"), "node", "left_anti"), "level")
            found = found.unionByName(level.withColumn("distance", F.lit(hop).cast("long")))
            best = found.groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score")).limit(most)
            last = best.agg(F.min("score"), F.count("*")).first()
            level = level.where(F.col("score") * decay >= last[0]) if last[1] == most else level
    nearest = F.struct(F.col("score"), (-F.col("distance")).alias("near"))
    hits = found.groupBy(F.col("node").alias("id")).agg(F.max(nearest).alias("best"))
    rows = symbols.select("id", "name").join(hits, "id").select("id", "name", F.round("best.score", 6).alias("score"), (-F.col("best.near")).alias("distance"))
    return rows.orderBy(F.desc("score"), "id").limit(most)


def symbol_details(symbols: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 1, related: int = 10) -> DataFrame:
    """(target, section, id, name, file, depth) for targets (target): who calls a symbol and what it calls, each at its least number of
    calls up to `depth`, and up to `related` other symbols of its file, the least ids first. symbols are (id, name, file).

    All targets move together, so the number of rounds is the depth, not the number of targets.
    """
    sections = []
    for section, way in (("caller", flipped(edges)), ("callee", edges)):
        steps = table(way.select(F.col("src").alias("id"), "dst").distinct(), "steps")
        known = table(targets.select("target", F.col("target").alias("id"), F.lit(0).cast("long").alias("depth")), "known")
        level = known
        for n in range(1, depth + 1):
            moved = level.join(steps, "id").select("target", F.col("dst").alias("id")).distinct()
            level = table(moved.join(known, ["target", "id"], "left_anti").withColumn("depth", F.lit(n).cast("long")), "level")
            known = known.unionByName(level)
        sections.append(known.where("depth > 0").withColumn("section", F.lit(section)))
    own = symbols.select(F.col("id").alias("target"), "file").join(targets, "target")
    others = own.join(symbols.select("id", "file"), "file").where("id <> target")
    near = others.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("id"))).where(F.col("n") <= related)
    sections.append(near.select("target", "id", F.lit(0).cast("long").alias("depth"), F.lit("related").alias("section")))
    rows = reduce(DataFrame.unionByName, sections)
    return rows.join(symbols.select("id", "name", "file"), "id").select("target", "section", "id", "name", "file", "depth")


def entry_points(symbols: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    """One row: entry_points, spelled name (file), of the symbols (id, name, file) labelled main, then of those labelled lib; by
    file, name and id, `most` at most. labels are (id, label)."""
    place = F.when(F.col("label") == "main", 0).when(F.col("label") == "lib", 1)
    rows = symbols.join(labels.where(F.col("label").isin("main", "lib")), "id").withColumn("place", place)
    few = rows.orderBy("place", "file", "name", "id").limit(most)
    listed = F.sort_array(F.collect_list(F.struct("place", "file", "name", "id")))
    return few.agg(F.transform(listed, lambda r: F.concat(r["name"], F.lit(" ("), r["file"], F.lit(")"))).alias("entry_points"))
