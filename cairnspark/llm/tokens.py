"""Token ids of whole texts by the tokenizers library, with a cache of words.

The byte-level vocabulary splits a text before it merges, and a single space always opens a new piece when the character
before it is not white space. So a text can be cut there, and equal words have equal ids wherever they stand. A line feed
between two characters that aren't white space is a piece of its own, and so is what is neither letter, digit nor white space
after letters: a text is cut there as well. Words are encoded once per task, many in one text with line feeds between them, and
looked up afterwards; the result is what encoding the whole text gives.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Letters and marks that make pieces of their own side by side.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]", c))
#: Line feeds that are a piece; a word that follows one has this mark in its place.
_BREAK, _MARK = r"([!-~])\n([!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])", "\0"
#: Words that are told apart by line feeds when they are encoded together: no white space is among these characters.
_JOINED, _TOGETHER = re.compile("\0?[!-~\xA1-\u05FF\u3041-\u30FF\u3400-\u9FFF\uAC00-\uD7A3]+"), 200


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file; tasks of the same worker share its cache."""
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes. capacity bounds the cache, not the input."""

    def __init__(self, path: str, capacity: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.model._resize_cache(0)  # this cache takes its place
        self._capacity = capacity
        self._spaced: dict[str, bytes] = {}
        self._feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words after a space, or, of those that begin with the mark, of a line feed and what follows."""
        joined = [x for x in words if _JOINED.fullmatch(x)] if len(self._feed) == 4 else []
        fresh: dict[str, bytes] = {}
        if joined:
            parts = [x[1:] if x[0] == _MARK else " " + x for x in joined]
            texts = ["\n".join([*parts[i : i + _TOGETHER], ""]) for i in range(0, len(parts), _TOGETHER)]
            flat = b"".join(self._ids(texts))
            ends = (np.flatnonzero(np.frombuffer(flat, "<u4") == np.frombuffer(self._feed, "<u4")[0]) * 4).tolist()
            if len(ends) == len(joined):
                begins = [0, *(x + 4 for x in ends[:-1])]
                fresh = {x: self._feed + flat[a:b] if x[0] == _MARK else flat[a:b] for x, a, b in zip(joined, begins, ends, strict=True)}
        rest = [x for x in words if x not in fresh]
        fresh.update(zip(rest, self._ids(["\n" + x[1:] if x[:1] == _MARK else " " + x for x in rest]), strict=True))
        return fresh

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words, each as in _fresh()."""
        known = self._spaced
        found = list(map(known.get, words))
        missing = [i for i, y in enumerate(found) if y is None]
        if missing:
            fresh = self._fresh([words[i] for i in missing])
            for i in missing:
                found[i] = fresh[words[i]]
            known.update((k, y) for k, y in fresh.items() if len(k) <= 64)
            if len(known) > self._capacity:  # the oldest quarter goes
                for x in list(islice(known, self._capacity // 4)):
                    del known[x]
        return found

    def _coded(self, words: pa.Array) -> pa.Array:
        """Ids of each word of a dictionary. Letters and the signs after them are two pieces, which are looked up apart."""
        bare = pc.utf8_ltrim(words, characters=_MARK)
        stems, signs = pc.utf8_rtrim(words, characters=string.punctuation), pc.utf8_ltrim(bare, characters=_LETTERS)
        size = lambda x: np.asarray(pc.binary_length(x)).astype(np.int64)
        marks = size(words) - size(bare)
        # letters before, signs behind, and nothing else
        plain = (marks <= 1) & (size(signs) > 0) & (size(bare) > size(signs)) & (size(stems) + size(signs) == size(words))
        coded = pc.if_else(pa.array(plain), stems, words).dictionary_encode()
        ids = pa.array(self._word_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), type=pa.large_binary()).take(coded.indices)
        tails = pc.if_else(pa.array(plain), signs, "").dictionary_encode()
        # a tail is what follows a line feed; no other cut leaves it alone
        of = [self._word_ids([_MARK + x])[0][len(self._feed) :] if x else b"" for x in tails.dictionary.to_pylist()]
        return pc.binary_join_element_wise(ids, pa.array(of, type=pa.large_binary()).take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; a null counts as the empty text."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _BREAK, rf"\1 {_MARK}\2"), " ")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        coded = lists.flatten().dictionary_encode()
        at, words = np.asarray(coded.indices), coded.dictionary
        # where white space stands before a space, a text can't be cut: such texts are encoded as they are, and so are those with the mark
        length = np.asarray(pc.binary_length(words))
        spaced = np.asarray(pc.binary_length(pc.utf8_rtrim_whitespace(words))) < length
        loose = (spaced | (length == 0))[at]
        loose[starts] = spaced[at[starts]]
        apart = np.logical_or.reduceat(loose, starts) | np.asarray(pc.match_substring(texts, " " + _MARK))
        rows = np.flatnonzero(apart).tolist()
        whole = dict(zip(rows, self._ids([texts[i].as_py() for i in rows]), strict=True)) if rows else {}
        first = self._ids(words.take(pa.array(at[starts])).to_pylist())
        # all words one after another; a text's first has no space before it
        joined = self._coded(words).take(coded.indices)
        _, ends, data = joined.buffers()
        ends, data = np.frombuffer(ends, dtype=np.int64)[joined.offset :], memoryview(data or b"")
        begin, end = ends[starts + 1].tolist(), ends[starts + sizes].tolist()
        return [whole[i] if i in whole else first[i] + data[begin[i] : end[i]] for i in range(len(sizes))]
