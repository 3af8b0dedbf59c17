"""Tokens, packing and shards: exact against the library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnspark.llm import packing, sstable
from cairnspark.llm.tokens import Encoder


@pytest.fixture(scope="module")
def exact(vocabulary):
    t = Tokenizer.from_file(vocabulary)
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_cached_ids_are_exact(vocabulary, exact):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " a", "word", "é", "1", "'s", "<|endoftext|>", "\x1c", "\x85", ".", "日本", "\n ", " \n", "w" * 80, "😀", "don't", "\x00", "ab.", "x,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    encoder = Encoder(vocabulary, capacity=300)
    for i in range(0, len(texts), 200):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts[i : i + 200]))]
        assert got == exact(texts[i : i + 200])
    assert encoder.encode(pa.array([None], type=pa.string())) == [b""]
    marked = encoder.encode(pa.array(["x <|endoftext|> y"]))[0]
    assert np.frombuffer(marked, "<u4").tolist() == [87, 220, 50256, 331]


def test_signs_and_line_feeds_cost_no_words_of_their_own(vocabulary, exact):
    texts = ["", *(f"of stone{a} und Stein{a}\nStein{a} \x00x\x00 Übel{a}\nÜbel \u180e\n'{a}" for a in ("", ".", ",", "$$$", "!!", "...", "_", "'", "'s", "\x00", "\n\n"))]
    encoder = Encoder(vocabulary)
    for part in (texts, texts[::-1], [x + "\n" + x for x in texts]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(part))] == exact(part)
    encoder = Encoder(vocabulary)
    encoder.encode(pa.array([f"of stone{a} stone{a}\nStein{a}" for a in ("", ".", ",", "$$$", "!!", "...", "&&&")]))
    # of, stone, Stein after a line feed, and six tails
    assert len(encoder._spaced) == 9


def test_windows_are_filled_as_far_as_lengths_allow():
    # 20 + 19 + 12 + 12 = 63 is the fullest, not 32
    rows = packing.plan({20: 1, 12: 2, 19: 1}, 64)
    assert {int(r[3]) for r in rows} == {0} and all(r[4] >= 0 for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(1, 30))}
    rows = packing.plan(histogram, 64, 1)
    filled: dict[int, set[int]] = {}
    seen: dict[int, int] = {}
    for (length, first, per, sequence, offset), nxt in zip(rows, [*rows[1:], None], strict=True):
        end = nxt[1] if nxt is not None and nxt[0] == length else histogram[length]
        assert first == seen.get(length, 0)
        for k in range(first, end):
            if offset < 0:
                for j, size in enumerate(packing.powers(int(length))):
                    filled.setdefault(sequence + (k - first) * len(packing.powers(int(length))) + j, set()).update(range(size))
            else:
                at = offset + (k - first) % per * length
                place = filled.setdefault(sequence + (k - first) // per, set())
                assert not place & set(range(at, at + length))
                place.update(range(at, at + length))
        seen[length] = end
    assert seen == histogram
    for place in filled.values():
        assert place == set(range(len(place))) and len(place) <= 64
        assert 64 - len(place) <= 1 or len(place) & (len(place) - 1) == 0


def test_pack(spark, odd_docs, no_docs, vocabulary, exact):
    pieces = packing.pack(odd_docs, vocabulary, window=256).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    total = 0
    expect = {}
    for r in texts:
        ids = [*exact([r["text"] or ""])[0], packing.END_ID]
        total += len(ids)
        expect.setdefault(r["doc_id"], []).append(ids)
    assert sum(p["length"] for p in pieces) == total
    for p in pieces:
        ok = [ids for ids in expect[p["doc_id"]] if len(ids) == p["doc_tokens"]]
        assert any(zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for ids in ok)
    of: dict[int, list] = {}
    for p in pieces:
        of.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256 and (256 - at <= 4 or at & (at - 1) == 0)
    assert packing.pack(no_docs, vocabulary).count() == 0


def test_sequences_hold_the_tokens(spark, vocabulary, exact):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    pieces = packing.pack(docs, vocabulary, window=64)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, pieces, vocabulary).collect()}
    expect = {r["doc_id"]: [*exact([r["text"]])[0], 1] for r in docs.collect()}
    for p in pieces.collect():
        assert rows[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]] == expect[p["doc_id"]][p["start"] : p["start"] + p["length"]]


def test_shards_round_trip(spark, odd_docs, no_docs, vocabulary, exact):
    manifest = sstable.write(odd_docs, vocabulary, shards=3)
    back = sstable.read(spark, manifest).collect()
    expect = sorted(((r["doc_id"], tuple([*exact([r["text"] or ""])[0], 2])) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x))
    got = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in back]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(expect, key=key)
    before = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == before
        before += len(r["ids"]) // 4
    ids = [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    shards = [r["uri"] for r in manifest.collect()]
    for wanted, n in ((2, 2), (7, 1), (None, 2), (99, 0), (-5, 0)):
        found = [x for u in shards for x in sstable.Reader(u).get(wanted)]
        assert len(found) == n
    assert sstable.read(spark, sstable.write(no_docs, vocabulary)).count() == 0


def test_keys_sort_as_ids():
    ids = [None, -(1 << 63), -5, 0, 7, 256, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids
