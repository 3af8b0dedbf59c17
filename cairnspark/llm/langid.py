"""Language identification by the nearest of several centroids per language, in TF-IDF space of byte n-grams.

Whole texts become normalised TF-IDF vectors of hashed byte trigrams. The centroids come from a bounded sample of labelled
texts, clustered by cosine in each language on the driver; every text is then compared with all centroids by cosine on Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import text_slices
from .docstats import text_bytes

#: At most about so many labelled rows train, spread over the languages (a hash of the id picks them when there are more).
MAX_TRAINING_ROWS = 8_000
WIDTH = 2048
#: Texts of fewer n-grams are too short for their distance to say anything.
LEAST_NGRAMS = 64
#: A cluster of a smaller share of its language's texts is not a centroid of its own; its texts go to the others.
LEAST_CLUSTER = 0.05
#: Lengths (n-grams) at which noise is compared with the centroids, noise texts of each, and one text in so many is held out for the limits.
NOISE_LENGTHS, NOISE_TEXTS, HELD_OUT = 2.0 ** np.arange(6, 17), 48, 5

_FOLD = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Hashed byte trigrams of lower-cased texts whose ASCII characters other than letters are spaces, a row per text."""
    data, sizes = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    out = np.zeros((len(sizes), WIDTH), dtype=np.float32)
    if len(data) < 3:
        return out
    folded = np.frombuffer(data.tobytes().translate(_FOLD), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    code = ((folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]) * np.uint32(2654435761)) >> np.uint32(21)
    inside = (owner[:-2] == owner[2:]) & ((folded[:-2] != 32) | (folded[1:-1] != 32))
    counts = np.bincount(owner[:-2][inside] * WIDTH + code[inside], minlength=len(sizes) * WIDTH)
    out[:] = counts.reshape(len(sizes), WIDTH)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a unit row each
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine below which a text is too far: a row for each centroid, a column for each of NOISE_LENGTHS

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and cosine for rows of n-gram counts."""
        cosine = _unit(np.sqrt(counts) * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, cosine[np.arange(len(best)), best]

    def too_far(self, counts: np.ndarray, best: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Whether texts are farther from their centroid than its limit at their length, straight between two known lengths."""
        x = np.clip(np.log2(np.maximum(counts.sum(axis=1), 1)) - np.log2(NOISE_LENGTHS[0]), 0, len(NOISE_LENGTHS) - 1)
        low = np.minimum(x.astype(np.int64), len(NOISE_LENGTHS) - 2)
        return cosine < self.least[best, low] * (1 - (x - low)) + self.least[best, low + 1] * (x - low)


def _clusters(rows: np.ndarray, most: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Unit means by spherical k-means, begun by k-means++ and left without clusters that are too small."""
    picked = [int(rng.integers(len(rows)))]
    while len(picked) < min(most, len(rows)):
        far = np.clip(1 - (rows @ rows[picked].T).max(axis=1), 0, None).astype(np.float64)
        if far.sum() < 1e-9 * len(rows):
            break
        picked.append(int(rng.choice(len(rows), p=far / far.sum())))
    means = rows[picked]
    while True:
        for _ in range(rounds):
            at = (rows @ means.T).argmax(axis=1)
            means = np.stack([_unit(rows[at == j].mean(axis=0)[None])[0] if (at == j).any() else means[j] for j in range(len(means))])
        size = np.bincount((rows @ means.T).argmax(axis=1), minlength=len(means))
        if len(means) == 1 or size.min() >= LEAST_CLUSTER * len(rows):
            return means
        means = np.delete(means, size.argmin(), axis=0)


def _noise(idf: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The 99th percentile of the cosines of random n-grams, centroid x length."""
    drawn = (rng.multinomial(int(n), np.full(WIDTH, 1 / WIDTH), NOISE_TEXTS) for n in NOISE_LENGTHS)
    return np.stack([np.quantile(_unit(np.sqrt(x) * idf) @ centroids.T, 0.99, axis=0) for x in drawn], axis=1)


def fit(languages: list[str], counts: np.ndarray, per_language: int = 4, rounds: int = 12) -> Model | None:
    """Cluster each language by spherical k-means (counts is used up). Every fifth text is held out of it, and a centroid's limit is
    halfway between the 1st percentile of its held-out texts and noise of the text's length, or that percentile if noise is nearer."""
    if not languages:
        return None
    rng, long = np.random.default_rng(20240229), counts.sum(axis=1) >= LEAST_NGRAMS
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    # in place: the sample is the largest thing on the driver
    x = np.sqrt(counts, out=counts)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    names = np.array(languages)
    known, centroids, owner, low = sorted(set(languages)), [], [], []
    for k, name in enumerate(known):
        mine = np.flatnonzero((names == name) & (norm[:, 0] > 0))
        if not len(mine):
            continue
        apart = np.arange(len(mine)) % HELD_OUT == HELD_OUT - 1
        means = _clusters(x[mine[~apart]], per_language, rounds, rng)
        # texts that are too short to be rejected say nothing about the limit
        judged = mine[apart & long[mine]] if (apart & long[mine]).any() else mine
        cosine = x[judged] @ means.T
        at = cosine.argmax(axis=1)
        for j in range(len(means)):
            own = cosine[at == j, j]
            centroids.append(means[j])
            owner.append(k)
            low.append(float(np.quantile(own if len(own) else cosine.max(axis=1), 0.01)))
    if not centroids:
        return None
    noise, low = _noise(idf, np.stack(centroids), rng), np.array(low)[:, None]
    return Model(known, idf, np.stack(centroids), np.array(owner), np.minimum((noise + low) / 2, low))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, rows=400):
        counts = np.minimum(ngram_counts(batch.column("text")), 60_000).astype(np.uint16)
        rows = pa.array([r.tobytes() for r in counts], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), rows], names=["doc_id", "lang", "x"])


def train(docs: DataFrame, held_out: Column | None = None, max_rows: int = MAX_TRAINING_ROWS) -> Model | None:
    """A model from the texts and non-null languages of docs (doc_id, text, lang) that are not held out."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    known = known if held_out is None else known.where(~held_out)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = max_rows / max(len(sizes), 1)
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, share / n) * (1 << 30)))
    rows = known.where(keep).mapInArrow(_count, "doc_id long, lang string, x binary").toArrow().combine_chunks()
    # the same order however Spark dealt the rows
    ids = np.asarray(pc.fill_null(rows.column("doc_id"), -(1 << 63)))
    order = np.lexsort((np.array([zlib.crc32(x.as_buffer()) for x in rows.column("x")], dtype=np.int64), ids))
    # one copy of the sample beside Arrow's: it is the largest thing on the driver
    counts, languages = np.empty((len(order), WIDTH), dtype=np.float32), []
    for at, i in enumerate(order.tolist()):
        counts[at] = np.frombuffer(rows.column("x")[i].as_buffer(), dtype=np.uint16)
        languages.append(rows.column("lang")[i].as_py())
    del rows
    pa.default_memory_pool().release_unused()
    return fit(languages, counts)


def identify(docs: DataFrame, model: Model | None, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected for docs (doc_id, text); with `carry`, a struct `row` of all columns
    takes the place of doc_id.

    A text that is null or has no letter is 'und' with score 0 and rejected, and so is every text when there is no model.
    Otherwise lang_pred is the language of the nearest centroid (the first of equals), and `rejected` says that the text has
    LEAST_NGRAMS or more and is farther from it than the centroid's limit at its length. Repeated rows are judged one by one; other columns are not looked at.
    A text of any length counts whole, in one task; an empty table gives no rows.
    """

    named_by = "row" if carry else "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, rows=400):
            texts = pc.fill_null(batch.column("text"), "")
            spoken = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
            if model is None:
                named, score, rejected = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            else:
                counts = ngram_counts(texts)
                best, cosine = model.nearest(counts)
                named = np.array(model.languages, dtype=object)[model.owner[best]]
                named[~spoken] = "und"
                score = np.where(spoken, np.clip(cosine, 0, 1), 0).astype(np.float64)
                rejected = ~spoken | model.too_far(counts, best, cosine) & (counts.sum(axis=1) >= LEAST_NGRAMS)
            columns = [batch.column(named_by), pa.array(named.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=[named_by, "lang_pred", "score", "rejected"])

    rows = docs.select(F.struct("*").alias("row") if carry else "doc_id", "text")
    judged = T._parse_datatype_string("lang_pred string, score double, rejected boolean")
    return rows.mapInArrow(run, T.StructType([rows.schema[named_by], *judged.fields]))
