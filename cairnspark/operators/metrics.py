"""Counts, metrics, features, scores and ranks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed weights of the linear score.
WEIGHTS = {
    "loc": 0.1, "fan_in": 0.2, "fan_out": 0.15, "complexity": 0.25, "blocks": 0.1, "edges": 0.1, "density": 0.15, "lifetime": -0.05, "churn": 0.2,
}


def kind_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def fans(edges: DataFrame) -> DataFrame:
    """fan_in and fan_out of each node of edges (src, dst); both sides are counted in one pass."""
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(i).alias("i"), F.lit(1 - i).alias("o")) for c, i in (("src", 0), ("dst", 1))))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def file_metrics(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file of symbols (id, file_path, size): symbol_count, loc, fan_in, fan_out (edges from and to other files), complexity.
    Weights of the complexity are fixed values: 0.1 loc, 0.5 fan_in, 0.3 fan_out."""
    of = symbols.select(F.col("id").alias("node"), "file_path")
    src, dst = of.select(F.col("node").alias("src"), F.col("file_path").alias("from_file")), of.select(F.col("node").alias("dst"), F.col("file_path").alias("to_file"))
    across = edges.join(src, "src").join(dst, "dst").where("from_file <> to_file")
    sums = across.groupBy("from_file", "to_file").agg(F.count("*").alias("n"))
    out = sums.groupBy(F.col("from_file").alias("file_path")).agg(F.sum("n").alias("fan_out"))
    into = sums.groupBy(F.col("to_file").alias("file_path")).agg(F.sum("n").alias("fan_in"))
    base = symbols.groupBy("file_path").agg(F.count("*").alias("symbol_count"), F.sum("size").alias("loc"))
    rows = base.join(into, "file_path", "left").join(out, "file_path", "left").fillna(0, ["fan_in", "fan_out"])
    return rows.withColumn("complexity", F.round(0.1 * F.col("loc") + 0.5 * F.col("fan_in") + 0.3 * F.col("fan_out"), 6))


def symbol_metrics(symbols: DataFrame, edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per symbol (id, size): loc (1 at least), fan_in, fan_out over all edges, cyclomatic = 1 + blocks that don't fall through."""
    turns = blocks.where("lower(terminator) <> 'fallthrough'").groupBy(F.col("function_id").alias("id")).agg(F.count("*").alias("n"))
    rows = symbols.join(fans(edges).withColumnRenamed("node", "id"), "id", "left").join(turns, "id", "left").fillna(0, ["fan_in", "fan_out", "n"])
    return rows.select("id", F.greatest("size", F.lit(1)).alias("loc"), "fan_in", "fan_out", (F.col("n") + 1).alias("cyclomatic"))


#: Fixed kinds of blocks that depend on a condition.
CONDITIONAL = ("if", "match", "while", "for", "loop")


def features(metrics: DataFrame, blocks: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """The nine features of each symbol of metrics (id, loc, fan_in, fan_out, cyclomatic), in one wide join: blocks (function_id, kind),
    edges (function_id), versions (stable_id, snapshot_id). What a symbol doesn't have counts as 0."""
    flow = blocks.groupBy(F.col("function_id").alias("id")).agg(F.count("*").alias("blocks"), F.count_if(F.col("kind").isin(*CONDITIONAL)).alias("_conditional"))
    hops = edges.groupBy(F.col("function_id").alias("id")).agg(F.count("*").alias("edges"))
    past = versions.groupBy(F.col("stable_id").alias("id")).agg(F.countDistinct("snapshot_id").alias("lifetime"), F.count("*").alias("churn"))
    rows = metrics.join(flow, "id", "left").join(hops, "id", "left").join(past, "id", "left").fillna(0, ["blocks", "_conditional", "edges", "lifetime", "churn"])
    density = F.when(F.col("blocks") > 0, F.col("_conditional") / F.col("blocks")).otherwise(0.0)
    return rows.select("id", "loc", "fan_in", "fan_out", F.col("cyclomatic").alias("complexity"), "blocks", "edges", density.alias("density"), "lifetime", "churn")


def hotspots(metrics: DataFrame, limit: int, least_loc: int | None = None, least_in: int | None = None) -> DataFrame:
    for column, least in (("loc", least_loc), ("fan_in", least_in)):
        metrics = metrics if least is None else metrics.where(F.col(column) >= least)
    return metrics.orderBy(F.desc("complexity"), "file_path").limit(limit)


def linear_score(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted sum of feature columns, in the order of the weights."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name).cast("double") * w
    return total


def numbered(rows: DataFrame, order: Sequence[Column], name: str, parts: int = 64) -> DataFrame:
    """Unique numbers from 1 in a full order, without ordering the table in one task.

    Rows are range-partitioned by the order, numbered inside their part, and moved by the sizes of the parts before.
    """
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    inner = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row for each part
    return inner.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def ranked(rows: DataFrame, score: str, ident: str, parts: int = 64) -> DataFrame:
    """Unique ranks from 1 by score downward, ties by ident."""
    return numbered(rows, [F.desc(score), F.col(ident)], "rank", parts)


def greedy_batches(files: DataFrame, limit: int) -> DataFrame:
    """Batches of whole files in order (project, seq, size): a new one begins where the next file would pass `limit`.

    What a batch holds depends on all before it in its project, so a project's files pass in order through one task, which holds a
    sum and no files.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, room = None, 0, limit
        for frame in frames:
            out = []
            for project, size in zip(frame["project"], frame["size"], strict=True):
                if project != at:
                    at, batch, room = project, 0, limit
                if size > room and room < limit:
                    batch, room = batch + 1, limit
                room -= size
                out.append(batch)
            yield frame.assign(batch=out)[["project", "seq", "size", "batch"]]

    ordered = files.select("project", "seq", "size").repartition("project").sortWithinPartitions("project", "seq")
    return ordered.mapInPandas(run, "project long, seq long, size long, batch long")
