"""A stored vector index: cells around k-means centres, probed per query; and pairs of similar vectors by random projections."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.storage import drop_table, shared_path, table

#: Vectors that the centres and the number of probes are fitted on, at most; all vectors are assigned and searched.
FITTED_ON = 20_000
MOST_CELLS = 2048
#: Vectors and queries that meet in one product of matrices.
PART = 4096
#: Rows of a product of matrices that are looked at in one piece.
STRIPE = 256


def _units(rows: pd.Series) -> np.ndarray:
    return as_units(np.stack(rows.to_numpy()), len(rows))


def as_units(flat: np.ndarray, n: int) -> np.ndarray:
    """The numbers of n vectors of one length, one after the other, as a matrix of unit vectors; zero ones stay zero."""
    x = flat.reshape(n, -1).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)


def products_over(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of all rows of x and rows of y with a product at or over the threshold; a stripe of x at a time."""
    found = []
    for at in range(0, len(x), STRIPE):
        near = (x[at : at + STRIPE] @ y.T).ravel()
        k = np.flatnonzero(near >= threshold)
        found.append((k + at * len(y), near[k]))
    k, near = (np.concatenate(f) for f in zip(*found, strict=True))
    return *np.divmod(k, len(y)), near


def _most(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, value) of the k greatest of each row, the first of equals."""
    last = max(0, near.shape[1] - k)
    i, j = np.nonzero(near >= np.partition(near, last, axis=1)[:, last, None])
    order = np.lexsort((j, -near[i, j], i))
    i, j = i[order], j[order]
    # a row's own places, of which equals of the k-th may be too many
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], near[i[keep], j[keep]]


def stored_blocks(rows: DataFrame, size: int) -> DataFrame:
    """A table of vectors (id, part, vec) in blocks of about `size`: block, and arrays id, part and vec, which holds all numbers in
    a row. Pairs of blocks are read from it, so that a vector is shuffled once however many others it meets."""
    n = max(1, -(-rows.count() // size))
    listed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "part", "vec")).alias("r"))
    return table(listed.select("block", "r.id", "r.part", F.flatten("r.vec").alias("vec")), "blocks")


def _centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors keeps its centre."""
    c = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells, nearest first, that hold `recall` of the k nearest of some fitted vectors."""
    asked = x[:: max(1, len(x) // 200)]
    near = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    own = np.argmax(x @ c.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, ceil(recall * len(needed)) - 1)]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """Rows (cell, id, vec) sorted by cell, and what fits in memory: centres, each cell's widest angle and size, and probes."""

    rows: DataFrame
    centres: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray
    probes: int


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, k: int = 10, recall: float = 0.98) -> str:
    """Store an index of vectors (id, vec) and return its folder. Null and zero vectors are near to nothing and left out.

    The centres (the root of the number of vectors, MOST_CELLS at most, unless given) and the number of probes that finds `recall` of
    the k nearest are fitted on at most FITTED_ON vectors; every vector is assigned to its nearest centre. Rows are dealt out by
    ranges of cell and id, so a cell of any size spreads over files, and a probe reads the folder of its cell only.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec is not null and exists(vec, x -> x <> 0)").select("id", F.col("vec").cast("array<double>").alias("vec"))
    total = rows.count()
    path = path or shared_path(spark, "vector-index")
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(FITTED_ON).select("vec").toPandas()["vec"]
    x = _units(fitted) if len(fitted) else np.zeros((1, 1))
    cells = max(1, min(cells or min(ceil(sqrt(total)), MOST_CELLS), len(x)))
    centres = _centres(x, cells)
    probes = _probes(x, centres, k, recall)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = _units(f["vec"]) @ centres.T
                own = np.argmax(near, axis=1)
                yield f.assign(cell=own, near=near[np.arange(len(f)), own])

    kind = vectors.schema["id"].dataType.simpleString()
    placed = table(rows.mapInPandas(assign, f"id {kind}, vec array<double>, cell long, near double"), "assigned")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").select("cell", "id", "vec").write.partitionBy("cell").parquet(f"{path}/rows")
    # a row for each cell
    widest = placed.groupBy("cell").agg(F.acos(F.least(F.min("near"), F.lit(1.0))).alias("widest"), F.count("*").alias("n")).toPandas()
    drop_table(placed)
    meta = {"probes": probes, "centres": centres.tolist(), "widest": [0.0] * cells, "sizes": [0] * cells}
    for cell, angle, n in zip(widest["cell"], widest["widest"], widest["n"], strict=True):
        meta["widest"][int(cell)], meta["sizes"][int(cell)] = float(angle), int(n)
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")
    return path


def load(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    return VectorIndex(spark.read.parquet(f"{path}/rows"), *(np.array(meta[n]) for n in ("centres", "widest", "sizes")), meta["probes"])


def _scored(index: VectorIndex, probed: DataFrame, k: int, own: str) -> DataFrame:
    """(qid, id, similarity) of the k best of each query among the cells that it probes: probed (qid, qvec, cell).

    A cell's vectors and its queries are cut into parts of about PART, and each pair of parts is one product of matrices, so no
    group grows with a cell or with the number of queries.
    """
    asked = probed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("qparts"))
    parts = F.greatest(F.ceil(F.element_at(F.lit([int(n) for n in index.sizes]), (F.col("cell") + 1).cast("int")) / PART), F.lit(1)).cast("int")
    sized = asked.withColumn("parts", parts)
    # at most as many as there are cells; the folders of all others are not read
    read = [r["cell"] for r in asked.collect()]
    # a folder's number is read as int, and int and long keys of one value fall into different partitions of a cogroup
    left = index.rows.where(F.col("cell").isin(read)).join(sized, "cell").select(F.col("cell").cast("long").alias("cell"), "id", "vec", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"))
    right = probed.join(sized, "cell").select("cell", "qid", "qvec", F.pmod(F.xxhash64("qid"), F.col("qparts")).cast("int").alias("qpart"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"qid": [], "id": [], "similarity": []})
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        x, ident, qid = _units(rows["vec"])[order], rows["id"].to_numpy()[order], queries["qid"].to_numpy()
        asked, found = _units(queries["qvec"]), []
        for at in range(0, len(asked), STRIPE):
            i, j, near = _most(np.round(asked[at : at + STRIPE] @ x.T, 6), k)
            found.append(pd.DataFrame({"qid": qid[at + i], "id": ident[j], "similarity": near}))
        return pd.concat(found)

    keys = ["cell", "part", "qpart"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, own)
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(qid, id, similarity, rank) of the k nearest of each query (qid, qvec), qids unique, by cosine rounded to six places, ties by id.

    Each query reads its `probes` nearest cells (as fitted by default). With `exact`, it then also reads every other cell that
    may hold a vector nearer than its k-th so far: none is when the angle to the centre less the cell's widest angle is larger.
    Null and zero queries have no rows.
    """
    centres, widest, filled = index.centres, index.widest, index.sizes > 0
    most = min(probes or index.probes, len(centres))
    ids = {n: t.dataType.simpleString() for n, t in (("qid", queries.schema["qid"]), ("id", index.rows.schema["id"]))}
    own = f"qid {ids['qid']}, id {ids['id']}, similarity double"
    asked = queries.where("qvec is not null and exists(qvec, x -> x <> 0)").select("qid", F.col("qvec").cast("array<double>").alias("qvec"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = np.argsort(-(_units(f["qvec"]) @ centres.T), axis=1, kind="stable")[:, :most]
                yield f.assign(cell=list(near)).explode("cell").astype({"cell": "int64"})

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            to_centre = _units(f["qvec"]) @ centres.T
            before = np.argsort(np.argsort(-to_centre, axis=1, kind="stable"), axis=1) < most
            angle = np.arccos(np.clip(to_centre, -1, 1)) - widest
            # similarities are rounded, so the bound leaves room for half a unit of the sixth place
            may = ~before & filled & (np.cos(np.clip(angle, 0, pi)) >= f["kth"].to_numpy()[:, None] - 1e-6)
            row, cell = np.nonzero(may)
            yield f[["qid", "qvec"]].iloc[row].assign(cell=cell)

    schema = f"qid {ids['qid']}, qvec array<double>, cell long"
    found = _scored(index, table(asked.mapInPandas(first, schema), "probed"), k, own)
    if exact:
        found = table(found, "first-hits")
        kth = found.groupBy("qid").agg(F.min("similarity").alias("kth"), F.count("*").alias("n")).select("qid", F.when(F.col("n") == k, F.col("kth")).alias("kth"))
        left = asked.join(kth, "qid", "left").fillna(-2.0, ["kth"])
        more = _scored(index, table(left.mapInPandas(rest, schema), "probed"), k, own)
        found = _best(found.drop("rank").unionByName(more.drop("rank")), k)
    return found.select("qid", "id", "similarity", "rank")


def nearest_of_all(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same without an index: every vector (id, vec) meets every query (qid, qvec) in products of matrices. A zero vector has
    similarity 0; null ones are left out."""
    rows = vectors.where("vec is not null").select(F.lit(0).cast("long").alias("cell"), "id", F.col("vec").cast("array<double>").alias("vec"))
    whole = VectorIndex(rows, np.zeros((1, 1)), np.zeros(1), np.array([rows.count()]), 1)
    ids = {n: t.dataType.simpleString() for n, t in (("qid", queries.schema["qid"]), ("id", vectors.schema["id"]))}
    asked = queries.where("qvec is not null").select("qid", F.col("qvec").cast("array<double>").alias("qvec"), F.lit(0).cast("long").alias("cell"))
    return _scored(whole, asked, k, f"qid {ids['qid']}, id {ids['id']}, similarity double").select("qid", "id", "similarity", "rank")


def similar_to(vectors: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of the asked vectors (id) and all vectors (id, part, vec) of other parts with a cosine at or over the threshold,
    exact; ids unique. Both are cut into parts of about PART, and a part of each is one product of matrices, so with few asked the
    vectors are read once. Zero and null vectors are similar to none."""
    rows = vectors.where("part is not null and vec is not null and exists(vec, x -> x <> 0)").select("id", "part", "vec")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "part")}
    queries = table(rows.join(asked.select("id").distinct(), "id", "left_semi"), "asked-vectors")
    n_rows, n_asked = (max(1, -(-x.count() // PART)) for x in (rows, queries))
    dealt = lambda x, n, other, m, at: x.withColumn(at, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = dealt(queries, n_asked, "two", n_rows, "one"), dealt(rows, n_rows, "one", n_asked, "two")

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        near = _units(some["vec"]) @ _units(others["vec"]).T
        i, j = np.nonzero((near >= threshold) & (some["part"].to_numpy()[:, None] != others["part"].to_numpy()[None, :]))
        return pd.DataFrame({"a": some["id"].to_numpy()[i], "b": others["id"].to_numpy()[j], "cosine": near[i, j]})

    return left.groupBy("one", "two").cogroup(right.groupBy("one", "two")).applyInPandas(run, f"a {kinds['id']}, b {kinds['id']}, cosine double")


def similar_in_blocks(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """All pairs (a, b, cosine) of vectors (id, part, vec) of different parts, the lesser part first, with a cosine at or over the threshold.

    Every vector meets every other one, so work grows with the square of their number: vectors are cut into blocks, and two
    blocks at a time are one product of matrices. A block is one row of a table, and pairs of its rows are read from there, so
    each vector is shuffled once. Zero and null vectors are similar to none.
    """
    rows = vectors.where("part is not null and vec is not null and exists(vec, x -> x <> 0)").select("id", "part", "vec")
    kind = rows.schema["id"].dataType.simpleString()
    blocks = stored_blocks(rows, block)
    side = lambda at: blocks.select(*(F.col(c).alias(f"{at}_{c}") for c in ("block", "id", "part", "vec")))
    met = side("one").hint("shuffle_replicate_nl").join(side("two"), F.col("one_block") <= F.col("two_block"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                i, j, cosine = products_over(as_units(r.one_vec, len(r.one_id)), as_units(r.two_vec, len(r.two_id)), threshold)
                p, q = np.asarray(r.one_part)[i], np.asarray(r.two_part)[j]
                # inside one block each pair comes both ways
                keep = np.flatnonzero(p < q if r.one_block == r.two_block else p != q)
                i, j, turned = i[keep], j[keep], (p > q)[keep]
                one, two = np.asarray(r.one_id)[i], np.asarray(r.two_id)[j]
                yield pd.DataFrame({"a": np.where(turned, two, one), "b": np.where(turned, one, two), "cosine": cosine[keep]})

    return met.mapInPandas(run, f"a {kind}, b {kind}, cosine double")


def four_places(x: Column) -> Column:
    """A positive number to four places, halves up; F.round goes through decimals, which takes longer than the product itself."""
    return F.floor(x * 1e4 + 0.5) / 1e4


def projection_shape(threshold: float, recall: float, bits: int) -> int:
    """Tables of `bits` random signs each with which vectors at the threshold share a bucket with the wanted recall."""
    same = (1 - acos(threshold) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - same)))


def similar_by_projection(vectors: DataFrame, threshold: float, recall: float = 0.95, bits: int = 8, block: int = 2048, seed: int = 11) -> DataFrame:
    """Pairs (a, b, cosine) of vectors (id, part, vec) of different parts, the lesser part first, with a cosine at or over the
    threshold; of pairs right at the threshold at least `recall` are found, of nearer ones more, and each pair once.

    A bucket is a table's signs against random planes. Buckets are cut into blocks, two of which are one product of matrices, and
    pairs are verified there by their whole vectors; a pair is kept in the first table that has it in one bucket only. Where there
    are as many tables as buckets of one, they would compare more pairs than there are, and all pairs are compared instead.
    """
    tables = projection_shape(threshold, recall, bits)
    if tables >= 1 << bits:
        return similar_in_blocks(vectors, threshold, block)
    rows = vectors.where("vec is not null and exists(vec, x -> x <> 0)").select("id", "part", F.col("vec").cast("array<double>").alias("vec"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "part")}

    def signs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for f in frames:
            if not len(f):
                continue
            x = _units(f["vec"])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
            values = ((x @ planes > 0).reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(axis=2)
            yield f.assign(keys=list(values))

    keyed = table(rows.mapInPandas(signs, f"id {kinds['id']}, part {kinds['part']}, vec array<double>, keys array<int>"), "signs")
    placed = keyed.select("*", F.posexplode("keys").alias("at", "key"))
    sizes = placed.groupBy("at", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    numbered = placed.join(sizes, ["at", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("id", "part", "vec", "keys", "at", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, part, ident = _units(f["vec"]), np.unique(f["part"].to_numpy(), return_inverse=True)[1], f["id"].to_numpy()
        keys, at = np.stack(f["keys"].to_numpy()), int(f["at"].iloc[0])
        one, two = np.flatnonzero(f["own"] == f["lo"]), np.flatnonzero(f["own"] == f["hi"])
        near = x[one] @ x[two].T
        i, j = np.nonzero((near >= threshold) & (part[one][:, None] != part[two][None, :]))
        value, i, j = near[i, j], one[i], two[j]
        earlier = (keys[i, :at] == keys[j, :at]).any(axis=1)
        turned = part[i] > part[j]
        keep = ~earlier & (~turned if f["lo"].iloc[0] == f["hi"].iloc[0] else True)
        return pd.DataFrame({"a": ident[np.where(turned, j, i)], "b": ident[np.where(turned, i, j)], "cosine": value})[keep]

    return dealt.groupBy("at", "key", "lo", "hi").applyInPandas(run, f"a {kinds['id']}, b {kinds['id']}, cosine double")
