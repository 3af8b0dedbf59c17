"""Full text and vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import tokens
from .vectors import nearest_of_all


def prefix_hits(symbols: DataFrame, prefix: str, k: int) -> DataFrame:
    """Up to 2k symbols with a word of their name that starts with the prefix, shorter names first, ties by id; score from 1 down
    to over 0.5 by place."""
    found = symbols.where(F.exists(tokens(F.col("name")), lambda t: t.startswith(prefix.lower())))
    top = found.select("id", "name").orderBy(F.length("name"), "id").limit(2 * k)
    w = Window.orderBy(F.length("name"), "id")  # over at most 2k rows
    n = top.agg(F.count("*").alias("n"))
    numbered = top.withColumn("i", F.row_number().over(w) - 1)
    return numbered.crossJoin(F.broadcast(n)).select("id", "name", F.round(1 - 0.5 * F.col("i") / F.col("n"), 6).alias("score"))


def bm25(docs: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of docs (id, text) that hold all query words: id, score. Only the query's words are counted in a document, so no
    inverted index of the corpus is shuffled; document frequencies and the mean length are one row."""
    words = sorted({w.lower() for w in query})
    listed = docs.select("id", tokens(F.col("text")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == F.lit(w))).cast("double")
    counts = [count(w).alias(f"tf{i}") for i, w in enumerate(words)]
    rows = listed.select("id", F.size("t").cast("double").alias("len"), *counts)
    totals = rows.agg(
        F.count("*").cast("double").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(words)))
    )
    score = F.lit(0.0)
    all_there = F.lit(True)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        all_there &= tf > 0
    return rows.crossJoin(F.broadcast(totals)).where(all_there).select("id", F.round(score, 6).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact k nearest of each query (qid, qvec) among vectors (id, vec) by cosine rounded to six places, ties by id: qid, id,
    similarity, rank. Both sides are cut into parts that meet as products of matrices, so neither is sent around whole; queries
    are a stated set. A stored index (functions.vectors) reads less."""
    return nearest_of_all(vectors, queries, k)


def hashed_embedding(rows: DataFrame, ident: str, text: str, dimension: int = 128) -> DataFrame:
    """(ident, vector): the bag of words as a unit vector. Each token adds one in the slot of its hash and its place; a text
    without tokens is all zero. Idents are unique."""
    placed = rows.select(ident, F.posexplode(tokens(F.col(text))).alias("i", "t"))
    counts = placed.groupBy(ident, F.pmod(F.pmod(F.xxhash64("t"), F.lit(dimension)) + F.col("i"), F.lit(dimension)).alias("slot")).agg(F.count("*").cast("double").alias("n"))
    found = counts.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("slots"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = lambda d: F.coalesce(F.try_element_at("slots", d.cast("long")) / F.col("norm"), F.lit(0.0))
    return rows.select(ident).join(found, ident, "left").select(ident, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value).alias("vector"))


def embed_text(kind: Column, name: Column, path: Column, body: Column) -> Column:
    """What is embedded for a symbol: kind, name, path and the first 1024 characters of the body, a line each."""
    return F.concat_ws("\n", kind, name, path, F.substring(body, 1, 1024))


def structure_hash(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """SHA-256 of the kinds of each group's nodes in order of byte_start, and how many there are."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "kind"))), lambda x: x["kind"])
    return nodes.groupBy(*by).agg(F.sha2(F.array_join(w, "|"), 256).alias("structure"), F.count("*").alias("n"))
