"""Ranked lexical search of all documents for a set of items: a threshold-seeded join.

Each term's k-th greatest impact is stored with it. That many documents have at least this score, so the greatest of an item's
terms is a bound that its k-th score can't be under. Terms whose greatest impacts together stay below the bound can bring no
document into the result alone: they generate no candidates. The other terms do, by a join on postings: first on one part in
SEEDED of the documents, whose k-th partial score raises the bound and so leaves fewer terms, then on all of them. The k-th of
the partial scores raises the bound once more, and what can still reach it is scored exactly with the terms that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SALTS, coded_words, drop_table, shuffles_removed, small, table, text_slices

#: One part in so many of the documents raises the bound before all of them are looked at.
SEEDED = 16
#: Terms are left out while they add less than this share of the bound: any share up to 1 is safe, a small one leaves more terms,
#: a large one more documents that can still reach the bound.
SPARED = 0.25
#: Each byte of UTF-8 as it counts in terms: ASCII letters lower-cased, other ASCII but digits a space, the rest as it is.
_TERM_BYTES = np.array([i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256)], dtype=np.uint8)


def _as_terms(texts: pa.Array) -> pa.Array:
    """The texts with spaces between their terms."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(_TERM_BYTES[data]), offset=texts.offset)


def counted_terms(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, term, tf) for each different term of each row's text, n being all its terms; and a row without term for each text
    that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            ids, counts, vocabulary = coded_words(_as_terms(part.column("text")), fold=False)
            owner = np.repeat(np.arange(len(counts)), counts)
            pairs, tf = np.unique(owner * max(len(vocabulary), 1) + ids, return_counts=True)
            own, term = np.divmod(pairs, max(len(vocabulary), 1))
            whole = np.flatnonzero(counts)
            at = np.concatenate([whole, own])
            terms = pa.chunked_array([pa.nulls(len(whole), vocabulary.type), vocabulary.take(pa.array(term))]).combine_chunks()
            arrays = [part.column(key).take(pa.array(at)), pa.array(counts[at]), terms, pa.array(np.concatenate([np.zeros(len(whole), np.int64), tf]))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n", "term", "tf"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, n long, term string, tf long")


def _bucket(value: Column) -> Column:
    """Places of whole numbers from 0 in the order of their six leading bits; buckets hold what differs by less."""
    low = F.greatest(F.floor(F.log2(value)) - 5, F.lit(0)).cast("int")
    low = F.when(value > 0, low).otherwise(0)
    return low * 32 + F.call_function("shiftright", value, low)


def kth_bounds(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """Per key: df (its rows), top (its greatest value) and kth: a value that k of its rows reach, 0 if it has fewer; at most a
    32nd below the k-th greatest. Counts per bucket of values are combined before the shuffle, so no key is ordered."""
    counts = rows.groupBy(by, _bucket(F.col(value)).alias("_b")).agg(F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_top"))
    reached = F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc("_b"))) >= k
    return counts.withColumn("_low", F.when(reached, F.col("_low"))).groupBy(by).agg(F.sum("_n").alias("df"), F.max("_top").alias("top"), F.coalesce(F.max("_low"), F.lit(0)).alias("kth"))


def _split(of_item: DataFrame) -> DataFrame:
    """Terms of items (item, tid, w, top, below, least) that lead, and `spare`: what the others add to a score at most."""
    split = of_item.withColumn("leads", F.col("below") >= F.col("least") * SPARED)
    spare = F.coalesce(F.sum(F.when(~F.col("leads"), F.col("top"))).over(Window.partitionBy("item")), F.lit(0))
    return split.withColumn("spare", spare)


def _parts(postings: DataFrame, of_item: DataFrame) -> DataFrame:
    """(item, row, part, spare): the scores of leading terms, where the others can still lift them to the bound."""
    leading = of_item.where("leads").select("item", "tid", "w")
    sums = postings.join(small(leading), "tid").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("part"))
    bounds = of_item.select("item", "least", "spare").distinct()
    return sums.join(small(bounds), "item").where("part + spare >= least").drop("least")


def _raised(parts: DataFrame, k: int) -> DataFrame:
    return kth_bounds(parts, "item", "part", k).select("item", F.col("kth").alias("raised"))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k documents (doc_id, text) that fit each item (item_id, text) best.

    Terms are runs of ASCII letters and digits and of all other characters from U+0080 on, with A-Z lower-cased. A term's weight
    is floor(1000 ln((2 N + 2) / (2 df + 1))) over the N documents with terms; a document's score sums, over an item's terms,
    weight * (1000000000 tf div (1000 tf + 20 m)) with m = 50 + 50 n N div L for its n terms of L in all. Scores are exact 64-bit
    numbers; only documents above 0 count, and equal scores go by doc_id, nulls first.

    Null and empty texts have no terms: such a document is no hit, such an item has no rows. Each row of docs is a document of
    its own, repeated ones too; rows of items with one item_id are one item with the terms of all, and a null item_id is an item.
    A text of any length is counted by one task. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    asked = table(counted_terms(items.select("item_id", "text"), "item_id").where("term is not null").select("item_id", "term").distinct(), "asked")
    item_ids = table(asked.select(F.col("item_id").alias("of_item")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    terms = table(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")

    # one scan of the texts: the postings of terms that are asked, and a row without term for each document
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc"), "text")
    found = counted_terms(rows, "doc").join(small(terms), "term", "left").where("tid is not null or term is null")
    # the id stands in the document's own row only
    own_id = F.when(F.col("tid").isNull(), F.col("doc.doc_id")).alias("doc_id")
    postings = table(found.select("doc.row", own_id, "n", "tid", "tf"), "postings")
    doc_ids = postings.where("tid is null").select("row", "doc_id")
    with shuffles_removed(spark):
        n_docs, n_terms = postings.where("tid is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # beyond 64 bits while it is multiplied, not after
    m = F.expr(f"50 + (cast(50 * n as decimal(20, 0)) * {n_docs}) div {max(n_terms, 1)}")
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("impact")
    postings = postings.where("tid is not null").withColumn("m", m.cast("long")).select("row", "tid", impact)

    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    stored = kth_bounds(postings, "tid", "impact", k).withColumn("w", weight)
    # a term without weight adds nothing
    stored = table(stored.where("w > 0").select("tid", "w", (F.col("w") * F.col("top")).alias("top"), (F.col("w") * F.col("kth")).alias("kth")), "kth-impacts")
    of_item = asked.join(item_ids, F.col("item_id").eqNullSafe(F.col("of_item"))).join(terms, "term").join(stored, "tid")
    whole, upward = Window.partitionBy("item"), Window.partitionBy("item").orderBy("top", "tid")
    of_item = of_item.select("item", "tid", "w", "top", F.max("kth").over(whole).alias("least"), F.sum("top").over(upward).alias("below"))
    of_item = table(of_item, "item-terms")
    seeds = _parts(postings.where(F.pmod(F.xxhash64("row"), F.lit(SEEDED)) == 0), _split(of_item))
    raised = table(_raised(seeds, k), "seeds")
    of_item = of_item.join(small(raised), "item", "left").withColumn("least", F.greatest("least", "raised")).drop("raised")
    of_item = table(_split(of_item), "item-terms")
    parts = table(_parts(postings, of_item), "parts")
    left = parts.join(small(_raised(parts, k)), "item").where("part + spare >= raised").drop("spare", "raised")
    left = table(left.join(doc_ids, "row"), "candidates")
    drop_table(parts)

    others = of_item.where("not leads").select("item", "tid", "w")
    looked_up = table(left.select("item", "row").join(small(others), "item"), "looked-up")
    added = postings.join(small(looked_up), ["row", "tid"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("added"))
    scored = left.join(added, ["item", "row"], "left").withColumn("score", F.col("part") + F.coalesce("added", F.lit(0))).where("score > 0")
    # an item's best k of each salted part, then of all
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("row")]
    for salted in (True, False):
        keys = ["item", F.pmod(F.hash("row"), F.lit(SALTS))] if salted else ["item"]
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return scored.join(small(item_ids), "item").select(F.col("of_item").alias("item_id"), "rank", "doc_id", "score")
