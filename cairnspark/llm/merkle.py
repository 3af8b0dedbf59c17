"""Merkle manifest of a dataset: leaves per document, runs of nodes hashed level by level to a root per source and one over all.

Each level is a window over group and parent index whose ordered full-frame list of digests is both the parent's preimage and
the siblings of each node; of a run only its first node stands for it at the next level. Five levels run inside one block of
243 consecutive nodes, so a block is dealt out once for all five windows, and what moves on to the next round is one row per
block. Proofs come down the same way: a block's rows join the one path above it. No group is ever in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import crc_of_id, shuffles_removed, small, table

FAN = 3
LEVELS = 5
BLOCK = FAN**LEVELS
#: monotonically_increasing_id() has the partition above these bits and the row below.
_ROW_BITS = 33


def part(value: Column) -> Column:
    """A value in a preimage: - if null, else its UTF-8 byte count, a colon and the value (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values one after another."""
    return F.sha2(F.concat(*values), 256)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Rows with their place `idx` (from 0, in this order) in their group and the group's row count `n`; written to a table.

    Rows are range-partitioned and sorted by group and order; a part's rows of a group are moved by those of the parts before,
    so a group may span any number of parts. One row per part and group is all that is summed up.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", at)
    dealt = table(dealt, name).withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS))
    sizes = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part")
    whole = Window.partitionBy(group)
    sizes = table(sizes.select(group, "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_move"), F.sum("_n").over(whole).alias("n")), "places")
    return dealt.join(small(sizes), [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_move")).drop("_at", "_part", "_move")


def climbed(nodes: DataFrame) -> DataFrame:
    """nodes (group, idx, n, h, ...) with their block, the digest `up` that stands for the block LEVELS levels above (fewer where
    one node is left before), and `steps`: what stands left and right of each ancestor in its run, level by level."""
    rows = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).repartition("group", "block")
    rows = rows.withColumns({"up": F.col("h"), "steps": F.expr("cast(array() as array<struct<left:string,right:string>>)")})
    for level in range(LEVELS):
        width = FAN**level
        parent = F.floor(F.col("idx") / (width * FAN))
        over = Window.partitionBy("group", "block", parent).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # a node of this level is listed once, by the first row below it
        rows = rows.withColumn("run", F.collect_list(F.when(F.col("idx") % width == 0, F.col("up"))).over(over))
        at = (F.floor(F.col("idx") / width) % FAN).cast("int")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(FAN)), "").alias("right"))
        several = F.col("n") > width
        rows = rows.withColumns(
            {"steps": F.when(several, F.concat("steps", F.array(step))).otherwise(F.col("steps")), "up": F.when(several, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("up"))}
        )
    return rows.drop("run")


def tree(nodes: DataFrame, name: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The rounds of nodes (group, idx, n, h), each with the finished groups above it, and the roots (group, h) of all groups."""
    rounds, roots = [], []
    while True:
        first = climbed(nodes).where(F.col("idx") % BLOCK == 0)
        above = table(first.select("group", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("up").alias("h")), name)
        done = above.where("n = 1").select("group", "h")
        rounds.append((nodes, done))
        roots.append(done)
        nodes = above.where("n > 1")
        with shuffles_removed(nodes.sparkSession):
            if nodes.isEmpty():
                return rounds, reduce(DataFrame.unionByName, roots)


def descended(rounds: list[tuple[DataFrame, DataFrame]], tops: DataFrame, name: str) -> DataFrame:
    """All nodes of the first round with their root `h_root`, what `tops` (group, path, ...) has for their group, and `path`: the
    steps from the node to the group's root, then those of `tops`."""
    known = None
    for nodes, done in reversed(rounds):
        upper = done.withColumnRenamed("h", "h_root").join(tops, "group").withColumn("block", F.lit(0).cast("long"))
        if known is not None:
            upper = upper.unionByName(known.withColumnRenamed("idx", "block").select(*upper.columns))
        found = climbed(nodes).drop("up").join(upper, ["group", "block"]).withColumn("path", F.concat("steps", "path")).drop("steps", "block")
        if nodes is rounds[0][0]:
            return found
        known = table(found.drop("h", "n"), name)
    raise AssertionError("a tree has a round")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs (doc_id, source, lang, n_chars, text).

    A leaf is the digest of the row's five values. Per source, leaves in order of doc_id (nulls first, then by leaf) are hashed
    in runs of three up to a subroot; subroots in order of source (null first, bytewise) up to the root. proof_sha256 is the
    digest of all siblings from the leaf to the root, and folded_root the root that they give with the leaf of `tampered`, the
    text as it was found later (the row's own text by default). Null and empty values differ; repeated rows are leaves of their
    own beside each other, alike in all but their siblings; a text of any length is one digest; an empty table gives an empty
    one. Other columns are not read.
    """
    fields = [part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text, other = part(F.col("text")), part(F.col("text") if tampered is None else tampered)
    # nulls before all texts, also as a key of joins
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("group")
    leaves = table(docs.select("doc_id", group, digest(*fields, text).alias("h"), digest(*fields, other).alias("found")), "leaves")
    nodes = numbered(leaves, "group", ["doc_id", "h"], "nodes")
    rounds, subroots = tree(nodes, "levels")
    below = table(subroots.withColumnRenamed("group", "of"), "subroots").withColumn("group", F.lit(""))
    top = numbered(below, "group", ["of"], "sources")
    top_rounds, roots = tree(top, "top-levels")
    nothing = F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path")
    paths = descended(top_rounds, roots.select("group", nothing), "top-paths")
    paths = table(paths.select(F.col("of").alias("group"), F.col("h_root").alias("root"), "path"), "source-paths")
    rows = descended(rounds, paths, "paths")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    named = rows.select("doc_id", F.col("h").alias("leaf"), F.col("h_root").alias("subroot"), "root", proof.alias("proof_sha256"), folded(F.col("found"), F.col("path")).alias("folded_root"))
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The text without its newlines where 2 divides the crc32 of the decimal doc_id (a null id counts as the empty text)."""
    return F.when(crc_of_id() % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
