"""Token counts against the library's own."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from cairnspark.llm import pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


PARTS = [
    " ", " ", "  ", "   ", "▁", "a", "e", "t", "the", "in", "\n", "\t", "é", "é", "\U0001f600", "Ａ", "ﬁ", "<s>", "</s>", "<0x0A>", "<unk>", "\x00",
    "0", "1", "==", "汉", "ß", "­", " ", "Quick", ".", "'s",
]


def test_counts(model, library):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["", " ", "  ", "▁", "▁▁", " " * 5000, "a" * 20_000, "ab " * 3000, "".join(chr(r.randint(33, 0x2FFF)) for _ in range(30_000))]
    found = pieces.Counter(model).count(pa.array(texts))
    assert found.tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


def test_cache_of_any_size(model, library):
    r = random.Random(2)
    texts = [" ".join(r.choice(PARTS) * r.randint(1, 4) for _ in range(30)) for _ in range(200)]
    counter = pieces.Counter(model, capacity=50)
    for _ in range(2):
        assert counter.count(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


def test_lowest_rank_first():
    """abc: bc ranks before ab, so a stays alone; of equal ranks the leftmost pair is joined."""
    assert pieces.merged("abc", {"ab": 1, "bc": 0}) == 1
    assert pieces.merged("aaa", {"aa": 0}) == 1 and pieces.merged("aaaa", {"aa": 0, "aaaa": 1}) == 3
    assert pieces.merged("", {}) == pieces.merged("a", {}) == 0


def test_rows(spark, odd_docs, no_docs, model, library, rows):
    found = pieces.count(odd_docs, model, limit=100)
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    counts = [len(x) for x in library.encode([t for _, t in texts], num_threads=1)]
    assert rows(found) == sorted(((i, len(t.encode()), n, n > 100) for (i, t), n in zip(texts, counts, strict=True)), key=str)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and rows(pieces.count(no_docs, model)) == []
