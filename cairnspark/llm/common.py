"""Helpers that several corpus operators share: shared tables, slices of Arrow batches, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import storage
from ..plans.storage import drop_table, shared_path, shuffles_removed  # noqa: F401  the operators import them from here


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it has few rows (of ids and hashes, 16 bytes each); the join shuffles otherwise."""
    with shuffles_removed(df.sparkSession):
        few = df.count() <= rows
    return F.broadcast(df) if few else df


def bounded_batches(spark: SparkSession, rows: int = 3000, size: str = "16m") -> None:
    """Keep the Arrow batches of this session small: texts are long, and each task holds several batches outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Tables after which the driver's garbage is dropped, and those since then.
TABLES_TO_LET_GO = 4
_tables_since = 0


def table(df: DataFrame, name: str) -> DataFrame:
    """storage.table(), after which the driver's JVM drops its garbage every few tables: plans, task results and broadcasts of an operator
    of many steps would otherwise fill the whole heap before it is collected, and the heap wouldn't shrink again."""
    global _tables_since
    written = storage.table(df, name)
    _tables_since += 1
    if _tables_since >= TABLES_TO_LET_GO:
        _tables_since = 0
        df.sparkSession._jvm.System.gc()
    return written


def let_go(spark: SparkSession) -> None:
    """Between the steps of a long job: drop the driver's garbage, in Python and in the JVM, so that its heap shrinks and Spark's
    cleaner removes the broadcasts and shuffle files of plans that are gone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text, for splits that must be the same everywhere; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: What a Python worker holds from one task to the next (the token cache); tasks of other operators let go of it.
held: dict[str, object] = {}


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20, rows: int = 1000, hold: bool = False
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most `rows` rows and about `limit` bytes of text; a single long text stays whole."""
    batch = None
    if held and not hold:
        held.clear()
        gc.collect()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 64
        group = np.cumsum(sizes) // limit + np.arange(batch.num_rows) // rows * (1 << 40)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    # the worker waits for its next task; what it doesn't use is better with the executor
    del batch
    pa.default_memory_pool().release_unused()


def coded_words(texts: pa.Array, pattern: str | None = None, fold: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of a slice of texts as (index of each word in the vocabulary, words per text, vocabulary).

    Words are what stands between ASCII white space (or between matches of `pattern`), lower-cased when `fold` is set.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.utf8_lower(texts) if fold else texts
    lists = pc.split_pattern_regex(texts, pattern=pattern) if pattern else pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    parent = pc.list_parent_indices(lists).filter(full)
    coded = words.filter(full).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    counts = np.bincount(np.asarray(parent), minlength=len(texts)).astype(np.int64)
    return np.asarray(coded.indices, dtype=np.int64), counts, coded.dictionary


def flat_words(texts: pa.Array, pattern: str | None = None, fold: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """coded_words() with the vocabulary as a list."""
    ids, counts, vocabulary = coded_words(texts, pattern, fold)
    return ids, counts, vocabulary.to_pylist()


def chained(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


SALTS = 64


def band_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all nodes of each bucket, for rows (node, bucket), which may repeat.

    Most buckets hold one node, and least, greatest and count of a bucket are combined before the shuffle. Two nodes are an
    edge at once; only the rows of larger buckets are looked up again and linked by stars in salted parts, then over the parts.
    """
    sums = rows.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("a"), F.count("*").alias("n"))
    sums = table(sums.where("a <> b"), "buckets")
    found = rows.join(small(sums.where("n > 2").select("bucket")), "bucket").select("bucket", "node").distinct()
    found = table(found.withColumn("salt", F.pmod("node", F.lit(SALTS))), "bucket-rows")
    parts = found.groupBy("bucket", "salt").agg(F.min("node").alias("m"), F.count("*").alias("n"))
    inner = found.join(parts.where("n > 1").select("bucket", "salt", "m"), ["bucket", "salt"]).where("node <> m")
    upper = parts.join(sums.select("bucket", "b"), "bucket").where("m <> b")
    stars = inner.select(F.col("node").alias("a"), F.col("m").alias("b")).unionByName(upper.select(F.col("m").alias("a"), "b"))
    return sums.where("n = 2").select("a", "b").unionByName(stars)


def components(edges: DataFrame, name: str = "components", done: Callable[[int], None] | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node reached.

    Alternating large-star and small-star steps: every step only replaces edges by edges to smaller nodes, no group is
    gathered anywhere (minima are combined before the shuffle, and the join back splits hot nodes), and the number of steps
    grows with the logarithm of the component size. Each step is a table in the shared folder. Nulls are dropped.
    """
    linked = edges.where("a is not null and b is not null and a <> b")
    current, rounds = table(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name), 0
    while True:
        # large-star: every larger neighbour of a node moves to the node's least neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: every smaller neighbour of a node, and by its least neighbour's row the node itself, moves to the least one
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a")
        following = table(large.join(nearest, "a").select(moved, F.col("m").alias("b")).distinct(), name)
        rounds += 1
        drop_table(current)
        current = following
        # a forest of stars is reached when every child has one parent and no node is both a child and a parent
        up = current.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        down = current.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        with shuffles_removed(current.sparkSession):
            unsettled = ends.where("up > 1 or up = 1 and down = 1").count()
        if not unsettled:
            break
    if done:
        done(rounds)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
