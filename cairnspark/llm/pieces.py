"""Token counts of a piece vocabulary by heap-and-linked-list byte-pair merging.

A text's symbols are its characters, with U+2581 for a space and one before the text. Adjacent symbols whose joint spelling is a
piece wait in a heap; the one of lowest rank (leftmost of equals) is popped and joined in a linked list, and its new neighbours
enter the heap. A character that is no piece is never joined and stands for its UTF-8 bytes. So a text's tokens are its initial
symbols less the merges, and no identifier is looked up.

No merge crosses two characters that no piece holds side by side, such as the end of a word and U+2581. Texts are parted there,
equal parts have equal counts wherever they stand, and each is merged once for as long as a worker's cache keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import held, text_slices

SPACE = "▁"


def merged(text: str, ranks: dict[str, int]) -> int:
    """How many merges a text takes: symbols are the spans [i, following[i]), linked both ways by their starts."""
    n = len(text)
    get, base, heap = ranks.get, n + 1, []
    # an entry is rank, start and end of the joint symbol in one number
    for i in range(n - 1):
        rank = get(text[i : i + 2])
        if rank is not None:
            heap.append((rank * base + i) * base + i + 2)
    if not heap:
        return 0
    heapify(heap)
    following, before, gone, done = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n), 0
    while heap:
        rest, end = divmod(heappop(heap), base)
        i = rest % base
        j = following[i]
        # an entry is stale unless it still spans two whole symbols
        if gone[i] or j >= n or following[j] != end:
            continue
        gone[j] = 1
        following[i] = end
        done += 1
        if end < n:
            before[end] = i
            rank = get(text[i : following[end]])
            if rank is not None:
                heappush(heap, (rank * base + i) * base + following[end])
        p = before[i]
        if p >= 0:
            rank = get(text[p:end])
            if rank is not None:
                heappush(heap, (rank * base + p) * base + end)
    return done


class Counter:
    """count(texts) gives the number of tokens of each text. capacity bounds the cache of words, not the input."""

    def __init__(self, path: str, capacity: int = 700_000) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        spelled = {i: model.id_to_piece(i) for i in plain}
        if model.normalize("ﬁ  Ａ ") != f"{SPACE}ﬁ{SPACE * 2}Ａ{SPACE}" or any(model.is_unused(i) for i in plain):
            raise ValueError("a vocabulary that rewrites texts or has unused pieces is not handled")
        if any(SPACE in x.lstrip(SPACE) for x in spelled.values()):
            raise ValueError("a vocabulary with pieces of several words is not handled")
        if not {c for x in spelled.values() for c in x} <= set(spelled.values()):
            raise ValueError("a vocabulary whose pieces have characters that are no pieces is not handled")
        # equal scores are equal ranks
        places = {s: i for i, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self._ranks = {x: places[model.get_score(i)] for i, x in spelled.items()}
        self._bridged = {x[i : i + 2] for x in spelled.values() for i in range(len(x) - 1)}
        self._capacity = capacity
        self._known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Tokens of a text that has its spaces as U+2581 already. It is parted where no piece holds both neighbours."""
        bridged, cut, total = self._bridged, 0, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in bridged:
                total += self._part(text[cut:i])
                cut = i
        return total + self._part(text[cut:])

    def _part(self, text: str) -> int:
        known = self._known
        n = known.get(text)
        if n is None:
            if len(text) == 1:
                n = 1 if text in self._ranks else len(text.encode())
            else:
                n = len(text) - merged(text, self._ranks)  # characters of no piece stand alone
            if len(text) <= 64:
                known[text] = n
        return n

    def words(self, found: list[str]) -> np.ndarray:
        known = self._known
        out = [known.get(x) for x in found]
        for i, n in enumerate(out):
            if n is None:
                out[i] = n = self.word(found[i])
                if len(found[i]) <= 64:
                    known[found[i]] = n
        if len(known) > self._capacity:  # the oldest quarter goes
            for x in list(islice(known, self._capacity // 4)):
                del known[x]
        return np.array(out, dtype=np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null counts as the empty text, which has none."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        lists = pc.split_pattern(texts, " ")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        empty = np.fromiter((not x for x in words), dtype=bool, count=len(words))[at]
        # a word after one space, or at the start of the text
        after_run = np.zeros(len(at), dtype=bool)
        after_run[1:] = empty[:-1]
        after_run[starts] = False
        single = ~empty & ~after_run
        used = np.zeros(len(words), dtype=bool)
        used[at[single]] = True
        counts = np.zeros(len(words), dtype=np.int64)
        counts[used] = self.words([SPACE + words[i] for i in np.flatnonzero(used)])
        total = np.bincount(owner[single], weights=counts[at[single]], minlength=len(sizes)).astype(np.int64)
        # runs of spaces, with the word behind them if there is one
        opening = np.flatnonzero(empty & ~after_run)
        if len(opening):
            following = np.append(np.flatnonzero(~empty), len(at))
            ends = np.minimum(following[np.searchsorted(following, opening)], (starts + sizes)[owner[opening]])
            texts_of, inside = owner[opening], ends < (starts + sizes)[owner[opening]]
            runs = [SPACE * int(e - o + w) + (words[at[e]] if w else "") for o, e, w in zip(opening, ends, inside, strict=True)]
            lone = (sizes[texts_of] == 1) & ~inside  # the empty text has no symbol before it
            np.add.at(total, texts_of, np.where(lone, 0, self.words(runs)))
        return total


def counter(path: str) -> Counter:
    """This Python worker's counter for a vocabulary file; tasks of the same worker share its cache."""
    if path not in held:
        held[path] = Counter(path)
    return held[path]


def count(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each row of docs (doc_id, text).

    Each row is counted by itself, so repeated rows give repeated rows and a hot source weighs nothing. A null text counts as
    empty: no bytes, no tokens. Null ids stay null; other columns are not read. A very long text is held by one task, with some
    tens of times its size while its words are parted; a word without spaces takes time by its length times the logarithm of
    it. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, hold=True):
            tokens = pa.array(counter(path).count(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text", size).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
