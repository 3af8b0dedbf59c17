"""Operators over the version axis: snapshots in order, and what symbols, edges and components are in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def as_of(versions: DataFrame, snapshot: int, stable_id: int | None = None) -> DataFrame:
    """Versions in exactly this snapshot."""
    found = versions.where(F.col("snapshot_id") == snapshot)
    return found if stable_id is None else found.where(F.col("stable_id") == stable_id)


def barcodes(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of versions and snapshots, the first and the last snapshot."""
    return versions.groupBy(*keys).agg(
        F.count("*").alias("n_versions"), F.countDistinct("snapshot_id").alias("n_snapshots"), F.min("snapshot_id").alias("first_seen"), F.max("snapshot_id").alias("last_seen")
    )


def lineages(versions: DataFrame, keys: list[str], snapshots: DataFrame) -> DataFrame:
    """born, last_seen, lifetime (snapshots it is in) and churn (segments less one) of each key.

    Segments are runs of neighbouring snapshots by their position in the order of all snapshots, not by their numbers. The
    positions are one row per snapshot.
    """
    place = snapshots.select("snapshot_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("snapshot_id")))
    rows = versions.select(*keys, "snapshot_id").distinct().join(F.broadcast(place), "snapshot_id")
    before = F.lag("place").over(Window.partitionBy(*keys).orderBy("place"))
    marked = rows.withColumn("starts", F.when(before.isNull() | (before + 1 != F.col("place")), 1).otherwise(0))
    return marked.groupBy(*keys).agg(
        F.min("snapshot_id").alias("born"), F.max("snapshot_id").alias("last_seen"), F.count("*").alias("lifetime"), (F.sum("starts") - 1).alias("churn")
    )


def status(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: snapshots, versions, distinct symbols, edges, newest snapshot."""
    one = versions.agg(F.countDistinct("snapshot_id").alias("snapshots"), F.count("*").alias("versions"), F.countDistinct("stable_id").alias("symbols"), F.max("snapshot_id").alias("newest"))
    return one.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def churn_top(versions: DataFrame, limit: int) -> DataFrame:
    return versions.groupBy("stable_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stable_id").limit(limit)


def latest_parent(snapshots: DataFrame, children: DataFrame) -> DataFrame:
    """For children (child) the greatest stored snapshot before it."""
    return children.join(snapshots.select("snapshot_id").distinct(), F.col("snapshot_id") < F.col("child")).groupBy("child").agg(F.max("snapshot_id").alias("parent"))


def copied_or_changed(parent: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of current with `copied`: whether parent has the same key with the same value, so that nothing is extracted again."""
    same = parent.select(key, F.col(value).alias("_old"))
    return current.join(same, key, "left").withColumn("copied", F.coalesce(F.col("_old") == F.col(value), F.lit(False))).drop("_old")


def every_nth(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first and every n-th row after it of each group."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.expr(f"(_nth - 1) % {n} = 0")).drop("_nth")


def snapshot_cycles(edges: DataFrame) -> DataFrame:
    """Components of two or more nodes of each snapshot of edges (snapshot_id, src, dst): snapshot_id, node, scc.

    All snapshots are worked on at once: a node of a snapshot is numbered by both, in one run of the cycle operator.
    """
    from .traversal import cycles

    pack = lambda c: F.struct("snapshot_id", F.col(c).alias("node"))
    found = cycles(edges.select(pack("src").alias("src"), pack("dst").alias("dst")))
    return found.select(F.col("node.snapshot_id").alias("snapshot_id"), F.col("node.node").alias("node"), F.col("scc.node").alias("scc"))
