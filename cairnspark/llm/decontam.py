"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into blocks of 8 words, and three neighbouring blocks are a passage. The blocks' TF-IDF matrix over hashed words
gets a randomised SVD (single-pass Nystrom form: all rows of all documents go into A'A times a random matrix, whose sum
over tasks is small). Passages and benchmark items are compared by cosine in the latent space; a passage that is near an
item and shares enough of its words is checked by the longest common subsequence of words and by the item's answer.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import chained, coded_words, table, text_slices

BLOCK, BLOCKS, FEATURES, RANK = 8, 3, 1 << 14, 64
#: Cosine and share of an item passage's words from which a passage is checked. The cosine is that of an item passage of 24 words;
#: of a shorter one, that fills less of a document's passage, it falls with the root of its share.
LEAST_COSINE, LEAST_SHARED = 0.4, 0.4
#: Least weight of a feature, however frequent; first words of an item that are looked for as they are.
LEAST_IDF, ANCHOR = 0.01, 8
#: Bits of a passage's set of words, which rule most pairs out before words are compared; cells of an item's table of words, and of
#: the table of anchors.
_BITS, _TABLE, _ANCHORS = 512, 1 << 12, 1 << 16
#: Share of an item's words in common order that is a leak, and that is one when the answer stands there too.
LEAK, LEAK_WITH_ANSWER, ANSWER_WORDS = 0.75, 0.5, 4
#: Words from which an answer is looked for wherever it stands; a shorter one only in passages that are near its item.
LEAST_ANSWER = 3
#: Items that are compared at once; more are handled in blocks of so many. Passages of either side in one product of matrices.
ITEMS_AT_ONCE, PRODUCT = 20_000, 4096


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """32-bit hashes of each text's words, lower-cased and without punctuation at their ends."""
    ids, counts, vocabulary = coded_words(texts)
    bare = pc.utf8_trim(vocabulary, characters=string.punctuation).to_numpy(zero_copy_only=False)
    hashed = (pd.util.hash_array(bare, categorize=False) >> np.uint64(32)).astype(np.uint32) if len(bare) else np.zeros(0, np.uint32)
    full = bare.astype(bool)
    keep = full[ids] if len(ids) else np.zeros(0, dtype=bool)
    kept = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
    return np.split(hashed[ids[keep]] if len(ids) else hashed, np.cumsum(kept)[:-1])


def blocks(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks x 8 word hashes, which places are filled, text of each block) for a list of texts."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    n = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(words)), n)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    at = np.repeat((np.cumsum(n) - n) * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    values, filled = np.zeros(len(owner) * BLOCK, dtype=np.uint32), np.zeros(len(owner) * BLOCK, dtype=bool)
    values[at], filled[at] = flat, True
    return values.reshape(-1, BLOCK), filled.reshape(-1, BLOCK), owner


def _places(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Feature of each place; FEATURES where there is no word."""
    return np.where(filled, values & np.uint32(FEATURES - 1), FEATURES).astype(np.int16)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=8 << 20, rows=4000):
        rows = pa.array([w.tobytes() for w in word_hashes(batch.column("text"))], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), rows], names=["doc_id", "text_hash", "words"])


def _word_lists(batches: Iterator[pa.RecordBatch], words: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in text_slices(batches, "words", 4 * words, 4000):
        yield batch, [np.frombuffer(x, dtype=np.uint32) for x in batch.column("words").to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, total = np.zeros(FEATURES + 1, dtype=np.int64), 0
    for _, words in _word_lists(batches):
        values, filled, _ = blocks(words)
        places = np.sort(_places(values, filled), axis=1)
        first = np.ones(places.shape, dtype=bool)
        first[:, 1:] = places[:, 1:] != places[:, :-1]
        counts += np.bincount(places[first], minlength=FEATURES + 1)
        total += len(values)
    counts[FEATURES] = total
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(counts)], names=["feature", "n"])


def _rows(matrix: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sum of the matrix's rows for each block."""
    out = np.empty((len(places), matrix.shape[1]), dtype=np.float32)
    for i in range(0, len(places), 2048):
        out[i : i + 2048] = matrix[places[i : i + 2048]].sum(axis=1)
    return out


def _omega(seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, RANK)).astype(np.float32)


def _ranged(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.vstack([_omega() * idf[:, None].astype(np.float32), np.zeros((1, RANK), dtype=np.float32)])
        total = np.zeros((RANK, FEATURES), dtype=np.float64)
        for _, words in _word_lists(batches):
            values, filled, _ = blocks(words)
            if not len(values):
                continue
            places = _places(values, filled)
            y = np.ascontiguousarray(_rows(start, places).T)
            flat = places.ravel()
            order = np.argsort(flat, kind="stable")
            order = order[: np.searchsorted(flat[order], FEATURES)]
            ordered, owner = flat[order], order // BLOCK
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
            for k in range(RANK if len(starts) else 0):
                total[k, ordered[starts]] += np.add.reduceat(y[k][owner], starts)
        used = np.flatnonzero(total.any(axis=0))
        flat = pa.array((total.T[used] * idf[used, None]).astype(np.float32).ravel(), type=pa.float32())
        lists = pa.ListArray.from_arrays(np.arange(0, len(used) * RANK + 1, RANK, dtype=np.int32), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), lists], names=["feature", "g"])

    return run


def latent_space(words: DataFrame) -> np.ndarray:
    """FEATURES x RANK: what a block's word counts are multiplied with for its latent coordinates (idf, singular vectors, and
    the inverse singular values). Every row of words takes part; FEATURES x RANK numbers come to the driver."""
    counted = words.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(FEATURES + 1)
    n[counted["feature"]] = counted["n"]
    idf = np.maximum(np.log((1 + n[FEATURES]) / (1 + n[:FEATURES])), LEAST_IDF)
    sums = words.mapInArrow(_ranged(idf), "feature long, g array<float>").groupBy("feature")
    rows = sums.agg(F.array(*(F.sum(F.get("g", F.lit(k)).cast("double")) for k in range(RANK))).alias("g")).toPandas()
    g = np.zeros((FEATURES, RANK))
    if len(rows):
        g[rows["feature"]] = np.array(rows["g"].tolist())
    omega = _omega().astype(np.float64)
    core = omega.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 1e-12) * 1e-9
    left, s, _ = np.linalg.svd(g @ vectors[:, keep] / np.sqrt(values[keep]), full_matrices=False)  # s squared: eigenvalues of A'A
    scaled = left / np.maximum(s, s.max(initial=1e-12) * 1e-3)
    return (scaled * idf[:, None]).astype(np.float32)


def passages(places: np.ndarray, owner: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit latent vectors of all passages, and the first block of each: three blocks, or all of a text that has no more."""
    vectors, n = _rows(space, places), len(owner)
    last = BLOCKS - 1
    begins = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, dtype=bool)
    full = np.zeros(n, dtype=bool)
    full[: max(0, n - last)] = owner[last:] == owner[: max(0, n - last)]
    first = np.flatnonzero(full | begins)
    joined = vectors[first]
    for k in range(1, BLOCKS):
        there = np.minimum(first + k, n - 1)
        joined += vectors[there] * ((first + k < n) & (owner[there] == owner[first]))[:, None]
    norm = np.linalg.norm(joined, axis=1, keepdims=True)
    return joined / np.where(norm > 0, norm, 1), first


def subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit by bit of the item."""
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    mask, row = (1 << len(item)) - 1, (1 << len(item)) - 1
    for w in region.tolist():
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & mask
    return len(item) - row.bit_count()


def _contains(region: np.ndarray, part: np.ndarray) -> bool:
    at = np.flatnonzero(region[: max(0, len(region) - len(part) + 1)] == part[0]) if len(part) else np.zeros(0, dtype=np.int64)
    return any((region[i : i + len(part)] == part).all() for i in at)


def _passage_words(values: np.ndarray, filled: np.ndarray, owner: np.ndarray, first: np.ndarray, empty: int) -> np.ndarray:
    """The words of passages, passages x 24, with `empty` where there is none."""
    clean, n, parts = np.where(filled, values, np.uint32(empty)), len(owner), []
    for k in range(BLOCKS):
        there = np.minimum(first + k, n - 1)
        parts.append(np.where(((first + k < n) & (owner[there] == owner[first]))[:, None], clean[there], np.uint32(empty)))
    return np.concatenate(parts, axis=1)


def _shared(asked: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many of each row's asked words are there."""
    return (asked[:, :, None] == there[:, None, :]).any(axis=2).sum(axis=1)


def _bits(words: np.ndarray, empty: int) -> np.ndarray:
    """A set of bits for each row of words, as whole numbers of 64."""
    cells = np.zeros((len(words), _BITS + 8), dtype=bool)
    cells[np.arange(len(words))[:, None], np.where(words != empty, words & np.uint32(_BITS - 1), _BITS)] = True
    return np.packbits(cells[:, :_BITS], axis=1).view(np.uint64)


def _common_bits(one: np.ndarray, i: np.ndarray, two: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many bits the rows i of one and k of two have in common; each column is taken by itself."""
    total = np.zeros(len(i), dtype=np.uint16)
    for x, y in zip(one, two, strict=True):
        total += np.bitwise_count(x[i] & y[k])
    return total


def _standing(flat: np.ndarray, first: np.ndarray, last: np.ndarray, item: np.ndarray, tables: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """How many words of each region flat[first:last] may be words of its item."""
    sizes, flat_tables = last - first, tables.ravel()
    out = np.zeros(len(sizes), dtype=np.int64)
    group = np.cumsum(sizes) // cells
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = sizes[a:b]
        before = np.cumsum(n) - n
        at = np.repeat(first[a:b] - before, n) + np.arange(int(n.sum()))
        hit = flat_tables[np.repeat(item[a:b] * _TABLE, n) + (flat[at] & np.uint32(_TABLE - 1))]
        summed = np.r_[0, np.cumsum(hit)]
        out[a:b] = summed[before + n] - summed[before]
    return out


def _tables(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(words), _TABLE), dtype=bool)
    for table_of, own in zip(out, words, strict=True):
        table_of[own & (_TABLE - 1)] = True
    return out


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return out


def _anchors(texts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes of the first words of texts, ANCHOR at most, and the texts they are of, by number of words; empty ones have none."""
    anchors = {}
    for width in {min(ANCHOR, len(w)) for w in texts} - {0}:
        of = np.array([i for i, w in enumerate(texts) if min(ANCHOR, len(w)) == width])
        hashes = np.array([_rolled(texts[i][:width], width)[0] for i in of])
        anchors[width] = np.sort(hashes), of[np.argsort(hashes, kind="stable")]
    return anchors


def _anchored(words: list[np.ndarray], anchors: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(text, item, place) where the first words of an item stand as they are; anchors: sorted hashes and items by number of words."""
    flat, ends = np.concatenate(words), np.cumsum([len(w) for w in words])
    low = np.uint64(_ANCHORS - 1)
    for width, (hashes, of) in anchors.items():
        rolled, may = _rolled(flat, width), np.zeros(_ANCHORS, dtype=bool)
        may[hashes & low] = True
        places = np.flatnonzero(may[rolled & low])
        rolled = rolled[places]
        first, last = np.searchsorted(hashes, rolled), np.searchsorted(hashes, rolled, side="right")
        for j in np.flatnonzero(last > first).tolist():
            i = int(places[j])
            doc = int(np.searchsorted(ends, i, side="right"))
            for item in of[first[j] : last[j]].tolist():
                yield doc, item, i - int(ends[doc]) + len(words[doc])


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], space: np.ndarray):
    """items: id, word hashes, hashes of the answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.vstack([space, np.zeros((1, space.shape[1]), dtype=np.float32)])
        texts = [w for _, w, _ in items]
        values, filled, owner = blocks(texts)
        asked, asked_first = passages(_places(values, filled), owner, padded)
        asked_item, none = owner[asked_first], 0xFFFFFFFF
        asked_words = _passage_words(values, filled, owner, asked_first, none)
        asked_size = (asked_words != none).sum(axis=1)
        least = (LEAST_COSINE * np.sqrt(asked_size / (BLOCKS * BLOCK))).astype(np.float32)
        item_tables, lists = _tables(texts), [w.tolist() for w in texts]
        # words that share a bit with another of their passage are counted as there
        asked_bits = _bits(asked_words, none)
        least_bits = LEAST_SHARED * asked_size - (asked_size - np.bitwise_count(asked_bits).sum(axis=1))
        asked_bits, lengths = np.ascontiguousarray(asked_bits.T), np.array([len(w) for w in texts])
        anchors = _anchors(texts)
        answers = [a if len(a) >= LEAST_ANSWER else a[:0] for _, _, a in items]
        answer_anchors = _anchors(answers)
        for batch, words in _word_lists(batches):
            hits: list[dict[int, float]] = [{} for _ in words]
            values, filled, owner = blocks(words)
            found: set[tuple[int, int, int]] = set()
            if len(values):
                vectors, first = passages(_places(values, filled), owner, padded)
                there = _passage_words(values, filled, owner, first, 0)
                begin = np.searchsorted(owner, np.arange(len(words)))
                for i in range(0, len(vectors), PRODUCT):
                    part = there[i : i + PRODUCT]
                    bits = np.ascontiguousarray(_bits(part, none).T)
                    for c in range(0, len(asked), PRODUCT):
                        near = vectors[i : i + PRODUCT] @ asked[c : c + PRODUCT].T >= least[c : c + PRODUCT]
                        row, q = np.divmod(np.flatnonzero(near), near.shape[1])
                        q = q + c
                        may = np.flatnonzero(_common_bits(bits, row, asked_bits, q) >= least_bits[q])
                        for j in range(0, len(may), 8192):
                            p, k = row[may[j : j + 8192]] + i, q[may[j : j + 8192]]
                            good = _shared(asked_words[k], there[p]) >= LEAST_SHARED * asked_size[k]
                            doc = owner[first[p[good]]]
                            found.update(zip(doc.tolist(), asked_item[k[good]].tolist(), ((first[p[good]] - begin[doc]) * BLOCK).tolist(), strict=True))
                found.update(_anchored(words, anchors))
            def checked(doc: int, item: int, region: np.ndarray, least: float) -> None:
                text = texts[item]
                known = region[item_tables[item][region & np.uint32(_TABLE - 1)]]  # other words are in no common subsequence
                # the subsequence is no longer than the item's words that stand there
                standing = set(known.tolist())
                if sum(w in standing for w in lists[item]) / len(text) >= least:
                    ratio = subsequence(text, known) / len(text)
                    if ratio >= least:
                        hits[doc][items[item][0]] = max(ratio, hits[doc].get(items[item][0], 0.0))

            # no subsequence is longer than the words of the item that its region may hold
            doc_of, item_of, at_of = np.array(sorted(found), dtype=np.int64).reshape(-1, 3).T
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            base, n = (np.cumsum(sizes) - sizes)[doc_of], lengths[item_of]
            first, last = np.maximum(at_of - n, 0), np.minimum(at_of + BLOCKS * BLOCK + n, sizes[doc_of])
            held_there = _standing(np.concatenate(words), base + first, base + last, item_of, item_tables)
            may = held_there / n >= np.array([LEAK_WITH_ANSWER if 0 < len(a) < LEAST_ANSWER else LEAK for _, _, a in items])[item_of]
            for doc, item, at in zip(doc_of[may].tolist(), item_of[may].tolist(), at_of[may].tolist(), strict=True):
                _, text, answer = items[item]
                region = words[doc][max(0, at - len(text)) : at + BLOCKS * BLOCK + len(text)]
                short = 0 < len(answer) < LEAST_ANSWER and _contains(region, answer)
                checked(doc, item, region, LEAK_WITH_ANSWER if short else LEAK)
            # where an answer stands, its item needs less: in as many words as it has, and a few
            for doc, item, at in _anchored(words, answer_anchors) if len(values) else ():
                _, text, answer = items[item]
                end, room = at + len(answer), len(text) + max(4, len(text) // 4)
                if end <= len(words[doc]) and (words[doc][at:end] == answer).all():
                    last = len(answer) <= len(text) and (text[len(text) - len(answer) :] == answer).all()
                    checked(doc, item, words[doc][max(0, (end if last else at) - room) : end if last else end + room], LEAK_WITH_ANSWER)
            listed = pa.array([sorted(h) for h in hits], type=pa.list_(pa.int64()))
            best = pa.array([max(h.values(), default=0.0) for h in hits], type=pa.float64())
            columns = [batch.column("doc_id"), batch.column("text_hash"), listed, best]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "item_ids", "overlap"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """doc_id, text_hash, item_ids (sorted ids of items that leaked into it), overlap (best share of an item, 0 to 1) for each row of docs
    (doc_id, text) against benchmark (item_id, text, and an answer column if named; else an item's last words are its answer).

    A leak has LEAK of an item's words in common order with it, near a passage whose cosine and words are near the item's, or
    LEAK_WITH_ANSWER of them in about as many words as the item has, where its answer stands (answers of LEAST_ANSWER words or
    more are looked for everywhere). A null or empty text has no leak; long texts are searched whole; items without words, or with a null id, are not looked for, and
    of items that fit equally well all are named; repeated rows are judged one by one; other columns are not looked at; an
    empty table gives no rows. Items come to the driver in blocks of ITEMS_AT_ONCE.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    words = table(base.mapInArrow(_hash, "doc_id long, text_hash long, words binary"), "words")
    items = benchmark.select("item_id", "text", F.col(answer).alias("answer") if answer else F.lit(None).cast("string").alias("answer"))
    items = items.where("item_id is not null and text is not null").dropDuplicates()
    total = items.count()
    clean = words.select("doc_id", "text_hash", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("overlap"))
    if not total:
        return clean
    space, parts, found = latent_space(words), -(-total // ITEMS_AT_ONCE), []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        texts = word_hashes(pa.array([r["text"] for r in rows], type=pa.string())) if rows else []
        answers = word_hashes(pa.array([r["answer"] for r in rows], type=pa.string())) if rows else []
        known = [(r["item_id"], t, a if r["answer"] else t[-ANSWER_WORDS:]) for r, t, a in zip(rows, texts, answers, strict=True) if len(t)]
        if known:
            found.append(words.mapInArrow(_search(known, space), "doc_id long, text_hash long, item_ids array<long>, overlap double"))
    if len(found) < 2:
        return found[0] if found else clean
    # each block of items has an answer for each row: a document's answer is what they have together
    every = chained(found).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("overlap").alias("overlap")
    )
    of = every.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "item_ids", "overlap")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    return words.select("doc_id", "text_hash").join(of, same).drop("of_id", "of_hash")
