"""Graph operators as frontier loops over edge tables.

A loop joins only what the last round added with the edges and merges it by a combinable minimum; every round is a table in
the shared folder, so plans stay short and a lost executor costs one round. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.storage import drop_table, table


#: Hops that one round of a frontier loop takes before its result is written.
HOPS = 4
#: Where edges have up to this many ends (counted first), sets of nodes are sent to the edges; otherwise both are shuffled.
SENT = 1_500_000


def _sender(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks sets of nodes (src, dst of stored edges) to be sent to the edges, if they are few enough."""
    ends = edges.agg(*(F.approx_count_distinct(c) for c in edges.columns)).first()
    return F.broadcast if max(ends) <= SENT else lambda nodes: nodes


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, stored: bool = False) -> DataFrame:
    """(node, depth) reached over edges (src, dst) from seeds (node), seeds at depth 0, by least number of hops up to `most`. Edges are
    written once for all rounds, unless they are `stored` already."""
    steps = edges.select(F.col("src").alias("node"), "dst")
    steps = steps if stored else table(steps.distinct(), "steps")
    frontier = table(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "reached")
    known, depth = [frontier], 0
    sent = _sender(steps)
    while not frontier.isEmpty() and (most is None or depth < most):
        hops, moved, found = HOPS if most is None else min(HOPS, most - depth), frontier.select("node"), []
        for i in range(1, hops + 1):
            moved = steps.join(sent(moved), "node").select(F.col("dst").alias("node")).distinct()
            found.append(moved.withColumn("depth", F.lit(depth + i).cast("long")))
        new = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("depth").alias("depth"))
        new = table(new.join(reduce(DataFrame.unionByName, known).select("node"), "node", "left_anti"), "reached")
        known.append(new)
        depth += hops
        # what the last hop added is all that can lead on
        frontier = new.where(F.col("depth") == depth)
    if not stored:
        drop_table(steps)
    return reduce(DataFrame.unionByName, known)


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dead(edges: DataFrame, entries: DataFrame, stored: bool = False) -> DataFrame:
    """Nodes of the call graph that no entry reaches: (node)."""
    edges = edges if stored else table(edges, "calls")
    universe = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return universe.join(reach(edges, entries, stored=True).select("node"), "node", "left_anti")


def blast(edges: DataFrame, of_file: DataFrame, target: DataFrame) -> DataFrame:
    """Who is hit when a target (node) changes: direct and transitive callers, score direct + transitive / 2, share of files, level.
    Levels are fixed values: HIGH from 20, MEDIUM from 10. of_file is (node, file); the result is one row."""
    hit = reach(flipped(edges), target).where("depth > 0")
    files = of_file.agg(F.countDistinct("file").alias("all_files"))
    hit = hit.join(of_file, "node", "left")
    sums = hit.agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.countDistinct("file").alias("files")
    )
    score = F.col("direct") + F.col("transitive") * 0.5
    level = F.when(score >= 20, "HIGH").when(score >= 10, "MEDIUM").otherwise("LOW")
    share = F.when(F.col("all_files") > 0, F.round(100.0 * F.col("files") / F.col("all_files"), 6)).otherwise(0.0)
    return sums.crossJoin(files).select("direct", "transitive", score.alias("score"), share.alias("risk"), level.alias("level"))


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have edges in and out, which all edges of a cycle have; self loops are not looked at."""
    current = table(edges.where("src <> dst").distinct(), "core")
    n, sent = current.count(), _sender(current.select("src", "dst"))
    while n:
        has_in = current.select(F.col("dst").alias("src")).distinct()
        has_out = current.select(F.col("src").alias("dst")).distinct()
        smaller = table(current.join(sent(has_in), "src", "left_semi").join(sent(has_out), "dst", "left_semi"), "core")
        left = smaller.count()
        drop_table(current)
        current = smaller
        if left == n:
            break
        n = left
    return current


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node over stored edges, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    current = table(nodes.withColumn("colour", F.col("node")).withColumn("changed", F.lit(True)), "colours")
    sent = _sender(edges.select("src", "dst"))
    while True:
        # only a node whose colour changed can change others; two hops are one table
        moved = current.where("changed").select("node", "colour")
        found = []
        for _ in range(2):
            moved = edges.select(F.col("src").alias("node"), "dst").join(sent(moved), "node").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("colour"))
            found.append(moved)
        new = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("colour").alias("new"))
        better = current.drop("changed").join(new, "node", "left").withColumn("better", F.col("new") < F.col("colour"))
        following = table(better.select("node", F.least("colour", "new").alias("colour"), F.coalesce("better", F.lit(False)).alias("changed")), "colours")
        busy = not following.where("changed").isEmpty()
        drop_table(current)
        current = following
        if not busy:
            return current.drop("changed")


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two or more nodes: (node, scc), scc the least member.

    Trimming leaves the core; in it, colours spread forward from least nodes, and what reaches a colour's own node backward
    inside the colour is its component. Components go and the rest repeats.
    """
    core, found = _trim(edges), []
    while not core.isEmpty():
        colours = _colours(core)
        src, dst = colours.select(F.col("node").alias("src"), F.col("colour").alias("cs")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inner = table(core.join(src, "src").join(dst, "dst").where("cs = cd").select("src", "dst"), "inner")
        seeds = colours.where("node = colour").select("node")
        back = reach(flipped(inner), seeds, stored=True)
        part = table(back.select("node").join(colours, "node").select("node", F.col("colour").alias("scc")), "components")
        for done in (inner, back, colours):
            drop_table(done)
        found.append(part)
        gone = part.select("node")
        left = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        smaller = _trim(left)
        drop_table(core)
        core = smaller
    drop_table(core)
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    sizes = every.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    return every.join(sizes.select("scc"), "scc", "left_semi").select("node", "scc")


def condense(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, scc) of all supernodes, and the distinct edges (src, dst) between them."""
    edges = table(edges.select("src", "dst"), "calls")
    scc = cycles(edges)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    members = table(nodes.join(scc, "node", "left").select("node", F.coalesce("scc", "node").alias("scc")), "members")
    src, dst = members.select(F.col("node").alias("src"), F.col("scc").alias("a")), members.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    between = edges.join(src, "src").join(dst, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return members, between


def simple_paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Simple paths (path array) from start (node) of one to `most` hops that end where nothing is called, or at the bound."""
    paths = start.select(F.array("node").alias("path"))
    out = table(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")), "steps")
    done = []
    for hop in range(1, most + 1):
        grown = paths.join(out, F.element_at("path", -1) == F.col("at")).where(~F.array_contains("path", F.col("next")))
        paths = table(grown.select(F.concat("path", F.array("next")).alias("path")), "paths")
        if hop == most:
            done.append(paths)
        else:
            done.append(paths.join(out.select("at").distinct(), F.element_at("path", -1) == F.col("at"), "left_anti"))
    return reduce(DataFrame.unionByName, done)


def collisions(symbols: DataFrame, by: str) -> DataFrame:
    """Values of a naming column that several symbols share: value, n, ids in order."""
    groups = symbols.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return groups.where("n > 1")


def decayed(edges: DataFrame, seeds: DataFrame, hops: int, decay: float = 0.7) -> DataFrame:
    """Search hits (node, score) spread over edges: each hop keeps `decay` of the score, and a node has its best one."""
    current = seeds.groupBy("node").agg(F.max("score").alias("score"))
    level = current
    for _ in range(hops):
        level = level.join(edges.select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * decay).alias("score"))
        current = current.unionByName(level).groupBy("node").agg(F.max("score").alias("score"))
    return current
