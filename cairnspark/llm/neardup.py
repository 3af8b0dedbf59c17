"""N-gram Jaccard join of documents: MinHash banding for candidates, full n-gram sets for the verdict.

Documents with the same set of word 5-grams are one class and are handled once. Class signatures are cut into bands, and
classes that share a band are candidates; band groups are linked by stars over salted parts, so no group is gathered.
The clusters that arise are then compared in full: a cluster is cut into blocks by hash, and every two blocks are one
group whose exact intersections are a product of incidence matrices. What leaves a group is a count of links and a local
component for each class, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import band_edges, components, drop_table, flat_words, table, text_slices

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 192
BLOCK_CLASSES, BLOCK_GRAMS = 2048, 1_500_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which `most` hashes find a pair at the threshold with the wanted chance. It is an
    error if no number of rows does."""
    for rows in range(most, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"{most} hashes can't find a pair at {threshold} with a chance of {recall}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def gram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; fewer words than n are one n-gram, no word none."""
    ids, counts, vocabulary = flat_words(texts)
    hashed = pd.util.hash_array(np.array(vocabulary, dtype=object), categorize=False) if vocabulary else np.zeros(0, dtype=np.uint64)
    stream, out, at = hashed[ids] if len(ids) else hashed, [], 0
    grams = np.zeros(max(0, len(stream)), dtype=np.uint64)
    if len(stream) >= words:
        rolled = np.zeros(len(stream) - words + 1, dtype=np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + stream[k : len(stream) - words + 1 + k]
        grams[: len(rolled)] = _mix(rolled)
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        else:
            own = np.zeros(1, dtype=np.uint64)
            for x in stream[at : at + n]:
                own = own * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(n)
            out.append(_mix(own) if n else own[:0])
        at += n
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each non-empty set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    draw = np.random.default_rng(20240229)
    a = draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(x * a[k] + b[k], starts).astype(np.uint64)
        band = k // rows
        out[:, band] = _mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band + 1))
    return out.view(np.int64)


_SHINGLED = "doc_id long, text_hash long, node long, n_grams int, bands array<long>"


def _shingle(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = gram_sets(batch.column("text"), words)
            full = [s for s in sets if len(s)]
            hashes = iter(band_hashes(full, bands, rows) if full else ())
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            listed = pa.array([next(hashes) if len(s) else None for s in sets], type=pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], type=pa.int32())
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(node, type=pa.int64()), sizes, listed]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SHINGLED.split(", ")])

    return run


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            grams = pa.array([s.tobytes() for s in gram_sets(batch.column("text"), words)], type=pa.binary())
            names = ["root", "node", "n_grams", "copies", "block", "blocks"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), grams], names=[*names, "grams"])

    return run


def _compare(numerator: int, denominator: int):
    """For the classes of two blocks of a cluster (or of one): links weighted with copies, and a local component."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n, size = len(f), f["n_grams"].to_numpy(dtype=np.int64)
        parts = [np.frombuffer(x, dtype=np.uint64) for x in f["grams"]]
        owner = np.repeat(np.arange(n), size)
        _, code, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count > 1  # an n-gram of one class adds to no intersection
        renumber = np.cumsum(shared) - 1
        owner, code = owner[shared[code]], renumber[code[shared[code]]]
        low, high = f["lo"].iloc[0], f["hi"].iloc[0]
        left, right = np.flatnonzero(f["block"] == low), np.flatnonzero(f["block"] == high)
        place = np.zeros(n, dtype=np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        is_left, is_right = np.isin(owner, left), np.isin(owner, right)
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        order = np.argsort(code, kind="stable")
        owner, code, is_left, is_right = owner[order], code[order], is_left[order], is_right[order]
        step = 2048
        for first in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(code, [first, first + step])
            x = np.zeros((len(left), step), dtype=np.float32)
            y = x if low == high else np.zeros((len(right), step), dtype=np.float32)
            x[place[owner[a:b][is_left[a:b]]], code[a:b][is_left[a:b]] - first] = 1
            if low != high:
                y[place[owner[a:b][is_right[a:b]]], code[a:b][is_right[a:b]] - first] = 1
            common += x @ y.T
        union = size[left][:, None] + size[right][None, :] - common
        linked = denominator * common >= numerator * union
        if low == high:
            np.fill_diagonal(linked, False)
        copies, node = f["copies"].to_numpy(dtype=np.int64), f["node"].to_numpy()
        links = np.zeros(n, dtype=np.int64)
        links[left] += linked @ copies[right]
        if low != high:
            links[right] += copies[left] @ linked
        label = node.copy()
        while True:  # the least node of each local component
            before = label.copy()
            far = np.iinfo(np.int64).max
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], far).min(axis=1, initial=far))
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], far).min(axis=0, initial=far))
            if (before == label).all():
                break
        return pd.DataFrame({"node": node, "links": links, "label": label})[links > 0]

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, keep_root: bool = False) -> DataFrame:
    """Classes, groups and links of docs (doc_id, text): doc_id, class_id, group_id, n_links, text_hash, a row per row of docs.

    Texts are split at ASCII white space and lower-cased. class_id is the least doc_id with the same set of n-grams,
    group_id the least doc_id connected by links, n_links the number of other rows at or over the threshold, copies
    included. A text without words links to nothing and is its own class and group (so a null id stays null). Repeated rows
    are copies of each other; ids need not be unique; other columns are not looked at; an empty table gives no rows. A pair
    at the threshold becomes a candidate with probability `recall`, and more similar pairs with a higher one. Node numbers
    are 64-bit hashes of n-gram sets. Long texts are taken whole. With keep_root there is also root, the number of the group
    (null without words), which tells groups apart whose least ids are the same.
    """
    bands, rows = choose_bands(threshold, recall)
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    shingled = table(base.mapInArrow(_shingle(bands, rows, words), _SHINGLED), "shingled")
    filled = shingled.where("node is not null")
    ids = filled.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("n_grams").alias("n_grams"))
    exploded = filled.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = exploded.select("node", F.xxhash64("band", "hash").alias("bucket"))
    clusters = components(band_edges(buckets), "clusters")
    # one text for each class in a cluster
    members = table(ids.join(clusters, "node"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("mass"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("mass") / BLOCK_GRAMS), F.lit(1)).cast("int")
    placed = members.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    chosen = filled.join(placed.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"))
    wanted = placed.join(chosen, "node").select("root", "node", "n_grams", "copies", "block", "blocks", F.col("of.doc_id").alias("of_id"), F.col("of.text_hash").alias("of_hash"))
    texts = base.join(wanted, base["doc_id"].eqNullSafe(wanted["of_id"]) & (base["text_hash"] == wanted["of_hash"]))
    texts = texts.select("root", "node", "n_grams", "copies", "block", "blocks", "text").mapInArrow(
        _grams(words), "root long, node long, n_grams int, copies long, block int, blocks int, grams binary"
    )
    # rows with the same id and text would come twice
    texts = table(texts, "grams").dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    ratio = np.array(threshold).astype(float).item()
    numerator, denominator = round(ratio * 1000), 1000
    found = table(
        dealt.groupBy("root", "lo", "hi").applyInPandas(_compare(numerator, denominator), "node long, links long, label long"), "links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), "groups")
    for used in (clusters, members, texts):
        drop_table(used)
    least = groups.join(ids, "node").groupBy("root").agg(F.min("class_id").alias("group_id"))
    of_node = ids.join(links, "node", "left").join(groups.join(least, "root").select("node", "root", "group_id"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return shingled.select("doc_id", "text_hash", "node").join(of_node, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash", *(["root"] if keep_root else [])
    )
