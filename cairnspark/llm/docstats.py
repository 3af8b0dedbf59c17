"""Statistics of whole texts, computed for a slice of texts at once with Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_words

SYMBOLS = "[#*$%&|<>]"

#: Byte classes for character histograms; a multi-byte character counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other_ascii", "control", "wide2", "wide3")


def _class_table() -> np.ndarray:
    kinds = np.full(256, CLASSES.index("control"), dtype=np.int64)
    for byte in range(33, 127):
        kinds[byte] = CLASSES.index("other_ascii")
    for name, chars in (
        ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t"),
        ("newline", "\n"), ("stop", ".,;:!?"), ("quote", "'\"`()[]-"), ("symbol", "#*$%&|<>"),
    ):
        kinds[list(chars.encode())] = CLASSES.index(name)
    kinds[0x80:0xC0] = -1
    kinds[0xC0:0xE0] = CLASSES.index("wide2")
    kinds[0xE0:] = CLASSES.index("wide3")
    return kinds


_KINDS = _class_table()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (no nulls) one after another, and the number of bytes of each."""
    joined = pc.binary_join(pa.array([texts.cast(pa.binary()).to_pylist()], type=pa.list_(pa.binary())), b"")[0].as_buffer()
    return np.frombuffer(joined, dtype=np.uint8), np.asarray(pc.binary_length(texts)).astype(np.int64)


def class_counts(texts: pa.Array) -> np.ndarray:
    """Characters of each class, a row per text."""
    data, sizes = text_bytes(pc.fill_null(texts, ""))
    kinds = _KINDS[data]
    owner = np.repeat(np.arange(len(sizes)), sizes) * len(CLASSES)
    first = kinds >= 0
    return np.bincount((owner + kinds)[first], minlength=len(sizes) * len(CLASSES)).reshape(len(sizes), -1)


def word_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and what scores add to them; a null text has no words."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    ids, n_words, vocabulary = flat_words(texts, fold=False)
    sizes = np.array([len(x) for x in vocabulary], dtype=np.int64) if vocabulary else np.zeros(1, dtype=np.int64)
    owner = np.repeat(np.arange(n), n_words)
    lengths = sizes[ids] if len(ids) else np.zeros(0, dtype=np.int64)
    per_word = lambda x: np.bincount(owner, weights=x, minlength=n)
    word_chars = per_word(lengths).astype(np.int64)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, owner, lengths)

    # words inside 3-word windows that their text holds at least twice
    repeat = np.zeros(len(ids), dtype=bool)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(ids) > 2 else np.zeros(0, dtype=np.int64)
    if len(at):
        _, pair = np.unique(ids[at] * (len(vocabulary) + 1) + ids[at + 1], return_inverse=True)
        _, window = np.unique(pair * (len(vocabulary) + 1) + ids[at + 2], return_inverse=True)
        _, own, count = np.unique(window * n + owner[at], return_inverse=True, return_counts=True)
        for found in (at[count[own] > 1],):
            repeat[found] = repeat[found + 1] = repeat[found + 2] = True
    # how often words occur in their own text
    if len(ids):
        key, own, count = np.unique(owner * (len(vocabulary) + 1) + ids, return_inverse=True, return_counts=True)
        holder = key // (len(vocabulary) + 1)
        distinct = np.bincount(holder, minlength=n)
        top = np.zeros(n, dtype=np.int64)
        np.maximum.at(top, holder, count)
        share = count / n_words[holder]
        entropy = np.bincount(holder, weights=-share * np.log2(share), minlength=n)
    else:
        distinct, top, entropy = np.zeros(n), np.zeros(n), np.zeros(n)
    same = np.zeros(len(ids), dtype=bool)
    if len(ids) > 1:
        same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])

    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    worded = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]")
    of = np.asarray(pc.list_parent_indices(lines).filter(worded)).astype(np.int64)
    coded = flat.filter(worded).dictionary_encode()
    line_ids = np.asarray(coded.indices).astype(np.int64)
    full_lines = np.bincount(of, minlength=n)
    unique_lines = np.bincount(np.unique(of * (len(coded.dictionary) + 1) + line_ids) // (len(coded.dictionary) + 1), minlength=n)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": np.asarray(pc.count_substring_regex(texts, SYMBOLS)).astype(np.int64),
        "n_lines": full_lines, "n_dup_lines": full_lines - unique_lines, "n_repeat_words": per_word(repeat).astype(np.int64),
        "longest_word": longest, "distinct_words": distinct, "top_word": top, "entropy": entropy, "adjacent": per_word(same),
    }


#: The document features of the quality score, in order.
FEATURES = (
    "log_words", "log_chars", "mean_word", "longest_word", "distinct_share", "top_share", "entropy", "adjacent_share", "repeat_share",
    "log_lines", "words_per_line", "dup_line_share", *(f"{c}_share" for c in CLASSES),
)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text, float32."""
    s, classes = word_stats(texts), class_counts(texts)
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(classes.sum(1), 1), np.maximum(s["n_lines"], 1)
    columns = [
        np.log1p(s["n_words"]), np.log1p(classes.sum(1)), s["word_chars"] / words, np.minimum(s["longest_word"], 1000), s["distinct_words"] / words,
        s["top_word"] / words, s["entropy"], s["adjacent"] / words, s["n_repeat_words"] / words, np.log1p(s["n_lines"]), s["n_words"] / lines,
        s["n_dup_lines"] / lines, *(classes / chars[:, None]).T,
    ]
    return np.stack(columns, axis=1).astype(np.float32)
