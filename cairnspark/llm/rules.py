"""Quality rules: how far a document's characters and common words are from its nearest language reference.

References are histograms over all documents of a language: classes of characters, and the language's common words with one
place for all others. A document is compared with every reference by Jensen-Shannon distance, and the nearest one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import flat_words, table, text_slices
from .docstats import CLASSES, class_counts, word_stats

#: Documents of fewer words are not judged by divergence.
LEAST_WORDS = 50
#: What is kept: a distance (base 2, 0 to 1) of character classes up to the first number, and of common words up to this share of
#: the way from the language's own texts of that length (0) to a text without any common word (1).
MOST_DISTANCE = (0.3, 0.9)
#: Lengths (words) at which texts drawn from a reference are compared with it, and how many of each.
LENGTHS, DRAWN = 2 ** np.arange(5, 17), 300
COMMON_WORDS = 100


@dataclass(frozen=True)
class References:
    languages: list[str]
    classes: np.ndarray  # language x class, rows sum to 1
    words: dict[str, int]  # common words of all languages
    shares: np.ndarray  # language x (common words, others)
    own: np.ndarray  # language x LENGTHS: word distance that 99 % of the texts drawn from the reference don't pass
    without: np.ndarray  # word distance of a text without common words from each language

    def most_words(self, nearest: np.ndarray, n_words: np.ndarray, share: float) -> np.ndarray:
        """The largest word distance that is kept, for texts by nearest language and length; where the language's own texts are as far
        as one without common words, theirs."""
        x = np.clip(np.log2(np.maximum(n_words, 1) / LENGTHS[0]), 0, len(LENGTHS) - 1)
        low = np.minimum(x.astype(np.int64), len(LENGTHS) - 2)
        own = self.own[nearest, low] * (1 - (x - low)) + self.own[nearest, low + 1] * (x - low)
        return own + share * np.maximum(self.without[nearest] - own, 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        langs, owner = np.unique(np.array(batch.column("lang").to_pylist()), return_inverse=True)
        counts = class_counts(batch.column("text"))
        ids, per_text, vocabulary = flat_words(batch.column("text"))
        sums = np.zeros((len(langs), len(CLASSES)), dtype=np.int64)
        np.add.at(sums, owner, counts)
        size = max(1, len(vocabulary))
        key, n = np.unique(np.repeat(owner, per_text) * size + ids, return_counts=True)
        lang = np.concatenate([np.repeat(np.arange(len(langs)), len(CLASSES)), key // size])
        kind = np.repeat([True, False], [sums.size, len(key)])
        item = list(CLASSES) * len(langs) + [vocabulary[k] for k in key % size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs[lang].tolist(), pa.string()), pa.array(kind), pa.array(item, pa.string()), pa.array(np.concatenate([sums.ravel(), n]))],
            names=["lang", "is_class", "item", "n"],
        )


def references(docs: DataFrame, common: int = COMMON_WORDS) -> References:
    """Histograms over all documents with a language; `common` words of each language come to the driver.

    A word is common only with a share of 1/1000 or more, so at most 1000 words of a language are ever ordered.
    """
    counted = (
        docs.select("text", "lang").where("lang is not null and text is not null")
        .mapInArrow(_counted, "lang string, is_class boolean, item string, n long")
        .groupBy("lang", "is_class", "item").agg(F.sum("n").alias("n"))
    )
    counted = table(counted, "word-counts")
    of_words = counted.groupBy("lang", "is_class", F.when(F.col("is_class"), F.col("item")).alias("class")).agg(
        F.sum("n").alias("n"), F.count("*").alias("items")
    )
    sums = of_words.collect()
    languages = sorted({r["lang"] for r in sums})
    totals = {r["lang"]: r["n"] for r in sums if not r["is_class"]}
    classes = np.zeros((len(languages), len(CLASSES)))
    for r in sums:
        if r["is_class"]:
            classes[languages.index(r["lang"]), CLASSES.index(r["class"])] = r["n"]
    floor = F.lit(None).cast("double")
    for lang, n in totals.items():
        floor = F.when(F.col("lang") == lang, F.lit(n / 1000)).otherwise(floor)
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    top = (
        counted.where(~F.col("is_class") & (F.col("n") >= floor))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= common)
        .collect()
    )
    words = {w: i for i, w in enumerate(sorted({r["item"] for r in top}))}
    shares = np.zeros((len(languages), len(words) + 1))
    for r in top:
        shares[languages.index(r["lang"]), words[r["item"]]] = r["n"] / totals[r["lang"]]
    shares[:, -1] = 1 - shares[:, :-1].sum(axis=1)
    own, without = _drawn(shares)
    return References(languages, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), words, shares, own, without)


def distances(histograms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row (which sums to 1, or to 0 for an empty text) from each reference."""
    p, q = histograms[:, None, :], references[None, :, :]
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=2)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def _drawn(shares: np.ndarray, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """References.own and References.without for shares (language x words)."""
    rng, own = np.random.default_rng(seed), np.zeros((len(shares), len(LENGTHS)))
    p = np.clip(shares, 0, None)
    for k in np.flatnonzero(p.sum(axis=1) > 0):
        for j, n in enumerate(LENGTHS):
            texts = rng.multinomial(int(n), p[k] / p[k].sum(), DRAWN) / n
            own[k, j] = np.quantile(distances(texts, shares[k : k + 1])[:, 0], 0.99)
    none = np.zeros((1, shares.shape[1]))
    none[0, -1] = 1
    return own, distances(none, shares)[0]


_COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nearest string, "
    "class_distance double, word_distance double, most_words double"
)


def measure(docs: DataFrame, refs: References, share: float = MOST_DISTANCE[1]) -> DataFrame:
    """The counts of each text of docs (doc_id, text), its nearest language, its distances from it and the largest word distance that
    is kept (null without references)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text")
            stats, n = word_stats(texts), len(texts)
            nearest, by_class, by_word, most = [None] * n, *np.full((3, n), np.nan)
            if refs.languages:
                classes = class_counts(texts).astype(np.float64)
                classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
                ids, per_text, vocabulary = flat_words(texts)
                place = np.array([refs.words.get(w, len(refs.words)) for w in vocabulary] or [0], dtype=np.int64)
                width = len(refs.words) + 1
                key = np.repeat(np.arange(n), per_text) * width + place[ids]
                words = np.bincount(key, minlength=n * width).reshape(n, width) / np.maximum(per_text, 1)[:, None]
                c = distances(classes, refs.classes)
                w = np.concatenate([distances(words[i : i + 64], refs.shares) for i in range(0, n, 64)])
                best, rows = (c + w).argmin(axis=1), np.arange(n)
                nearest, by_class, by_word = [refs.languages[i] for i in best], c[rows, best], w[rows, best]
                most = refs.most_words(best, np.asarray(stats["n_words"]), share)
            counts = [pa.array(stats[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns = [pa.array(nearest, pa.string()), pa.array(by_class, from_pandas=True), pa.array(by_word, from_pandas=True), pa.array(most, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *columns], names=[x.split()[0] for x in _COLUMNS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _COLUMNS)


def judge(docs: DataFrame, refs: References | None = None, most: tuple[float, float] = MOST_DISTANCE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The counts, base_failed, the distances and kept for each row of docs (doc_id, text, lang).

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed, and
    either shorter than the guard, without references, or within `most` (see MOST_DISTANCE) of the nearest language in both distances. A null or empty text has no words and fails; repeated rows are judged one by one; other columns don't matter.
    A text of any length counts whole, in one task; of languages that are equally near the first by name counts; an empty table
    gives no rows. With `least_words` at base_failed's 50 the guard saves no text; a greater one does.
    """
    measured = measure(docs, references(docs) if refs is None else refs, most[1])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = F.coalesce((F.col("class_distance") <= most[0]) & (F.col("word_distance") <= F.col("most_words")), F.lit(True))
    measured = measured.withColumn("base_failed", failed)
    return measured.withColumn("kept", ~failed & ((F.col("n_words") < least_words) | near)).drop("most_words")
