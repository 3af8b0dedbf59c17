"""Line dedup, n-gram join, decontamination, components and the pipeline, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import common, decontam, lines, neardup

from .conftest import prose


def union(pairs):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)]
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")
    got = {x["node"]: x["root"] for x in common.components(df).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]])


def edited(text, seed, n):
    words, r = text.split(" "), random.Random(seed)
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randint(0, 9999)}"
    return " ".join(words)


def char_sets(line, k=lines.SHINGLE):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_line_dedup_by_brute_force(spark):
    base = [prose(s, 40) for s in range(12)]
    rows = []
    for i in range(40):
        r = random.Random(i)
        rows.append((i, "\n".join([edited(r.choice(base), 100 + i, r.choice([0, 0, 1, 2, 12])), "", "short", prose(1000 + i, 20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    places = [(i, k, line) for i, t in rows for k, line in enumerate(t.split("\n")) if line.strip()]
    distinct = sorted({line for *_, line in places})
    sets = {line: char_sets(line) for line in distinct}
    roots = union([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if jaccard(sets[a], sets[b]) >= lines.THRESHOLD])
    first: dict = {}
    for i, k, line in places:
        first.setdefault(roots.get(line, line), (i, k))
    for i, t in rows:
        keep = [line for k, line in enumerate(t.split("\n")) if not line.strip() or first[roots.get(line, line)] == (i, k)]
        assert got[i] == "\n".join(keep)


def test_line_dedup_of_odd_documents(spark, odd_docs, no_docs):
    out = lines.dedup(odd_docs)
    assert out.columns == [*odd_docs.columns, "_n_lines", "_n_dropped"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    of = lambda i: [(r["text"], r["_n_lines"], r["_n_dropped"]) for r in rows if r["doc_id"] == i]
    assert of(3) == [(None, 0, 0)] and of(4) == [("", 0, 0)] and of(5) == [(" \n\t ", 0, 0)]
    assert of(1)[0][2] == 0 and of(2) == [("", 1, 1)] * 2
    assert of(8) == [("one\n\ntwo", 3, 1)]
    assert lines.dedup(no_docs).count() == 0


def word_sets(text, n=neardup.WORDS):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_join_by_brute_force(spark):
    rows = []
    for g in range(8):
        base = prose(g, 150)
        rows += [(len(rows) + i, edited(base, 50 * g + i, [0, 0, 1, 2, 3, 5, 20][i])) for i in range(7)]
    rows += [(100 + i, prose(500 + i, 30)) for i in range(10)] + [(200, None), (201, ""), (202, "two words"), (203, "Two  words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in neardup.join(docs).collect()}
    sets = {i: word_sets(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= neardup.THRESHOLD]
    roots = union(links)
    for i, _ in rows:
        assert got[i]["group_id"] == roots.get(i, i)
        assert got[i]["n_links"] == sum(i in p for p in links)
        assert got[i]["class_id"] == min([j for j in sets if sets[j] and sets[j] == sets[i]], default=i)


def test_blocks_do_not_change_the_join(spark, monkeypatch):
    base = prose(1, 120)
    docs = spark.createDataFrame([(i, edited(base, i, 1)) for i in range(30)], "doc_id long, text string")
    key = lambda: sorted((r["doc_id"], r["group_id"], r["n_links"]) for r in neardup.join(docs).collect())
    whole = key()
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 4)
    assert key() == whole


def test_join_of_odd_documents(spark, odd_docs, no_docs):
    rows = neardup.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r["n_links"] for r in rows if r["doc_id"] in (1, 2)] == [2, 2, 2]
    assert {r["group_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert neardup.join(no_docs).count() == 0


def test_bands_reach_their_recall():
    for t, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = neardup.choose_bands(t, recall)
        assert bands * rows <= neardup.MAX_HASHES and 1 - (1 - t**rows) ** bands >= recall
    with pytest.raises(ValueError):
        neardup.choose_bands(0.05, 0.999999)


def test_leaks(spark, odd_docs, no_docs):
    items = [(i, prose(900 + i, 15 + 3 * i)) for i in range(12)]
    rows = [(i, prose(i, 300)) for i in range(60)]
    rows += [(100 + i, f"{prose(300 + i, 90)} {t} {prose(400 + i, 70)}") for i, t in items]
    rows += [(200 + i, f"{prose(600 + i, 50)} {edited(t, i, 2)} {prose(700 + i, 50)}") for i, t in items if i > 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (None, "x y z"), (98, "...")], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.find_leaks(docs, bench).collect()}
    assert all(got[i] == [] for i in range(60))
    assert all(got[100 + i] == [i] for i, _ in items)
    assert sum(got[200 + i] == [i] for i, _ in items if i > 3) >= 7
    assert decontam.find_leaks(odd_docs, bench).count() == odd_docs.count()
    assert decontam.find_leaks(no_docs, bench).count() == 0
    assert all(r["item_ids"] == [] for r in decontam.find_leaks(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("share,with_answer", [(0.5, True), (0.6, True), (0.75, False), (0.75, True)])
def test_recall_of_leaks_at_the_limits(spark, share, with_answer):
    """Items of frequent words at any offset, as many words kept as the limit asks for, the others replaced by frequent ones. Every
    window of every document is compared, so what should be found is known; other documents have no window that is a leak."""
    r = random.Random(int(share * 100) + with_answer)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: r.choices(words, [1 / (k + 3) for k in range(3000)], k=n)
    items = [text(24) for _ in range(120)]
    rows, wanted = [], {}
    for i, item in enumerate(items):
        keep = set(range(20, 24)) if with_answer else set()
        keep |= set(r.sample([k for k in range(23 if not with_answer else 20) if k not in keep], round(24 * share) - len(keep)))
        leak = [w if k in keep else r.choice(words[:300]) for k, w in enumerate(item)]
        rows.append((i, " ".join(text(r.randint(0, 90)) + leak + text(r.randint(0, 90)))))
    rows += [(1000 + i, " ".join(text(150))) for i in range(200)]
    lcs = lambda a, b: decontam.subsequence(hashes[a], b)
    hashes = decontam.word_hashes(pa.array([" ".join(x) for x in items]))
    for doc, t in rows:
        own = decontam.word_hashes(pa.array([t]))[0]
        asked = [doc] if doc < 1000 else range(0, 120, 10)
        wanted[doc] = {i for i in asked for at in range(0, max(1, len(own) - 23)) if lcs(i, own[at : at + 24]) >= (0.5 if with_answer else 0.75) * 24}
    got = {x["doc_id"]: set(x["item_ids"]) for x in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert all(wanted[i] == {i} for i in range(120))
    assert sum(i in got[i] for i in range(120)) >= 0.9 * 120
    assert not any(got[1000 + i] for i in range(200))


def test_short_items_are_not_found_in_unrelated_texts(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choices(words, [1 / (k + 3) for k in range(400)], k=n))
    docs = spark.createDataFrame([(i, text(300)) for i in range(300)], "doc_id long, text string")
    found = decontam.find_leaks(docs, spark.createDataFrame([(i, text(12)) for i in range(60)], "item_id long, text string"))
    assert sum(len(x["item_ids"]) for x in found.collect()) <= 3


def test_item_blocks_do_not_change_leaks(spark, monkeypatch):
    items = [(i, prose(900 + i, 30)) for i in range(6)]
    docs = spark.createDataFrame([(i, f"{prose(i, 60)} {t} {items[0][1]}") for i, t in items] + [(9, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda: sorted((r["doc_id"], r["item_ids"]) for r in decontam.find_leaks(docs, bench).collect())
    whole = key()
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 2)
    assert key() == whole


def test_subsequence():
    a = lambda s: decontam.word_hashes(pa.array([s]))[0]
    assert decontam.subsequence(a("a b c d"), a("x a y c d z")) == 3
    assert decontam.subsequence(a("a"), a("b")) == 0


def test_pipeline_keeps_what_its_stages_keep(spark, tmp_path, odd_docs):
    import corpus_pipeline as cp

    items = [(0, prose(901, 40))]
    rows = [(i, "\n".join(prose(10 * i + k, 30) for k in range(3)), "en", "s", 1) for i in range(12)]
    rows += [(50, rows[0][1], "en", "s", 1), (51, f"{prose(77, 60)} {items[0][1]}", "en", "s", 1), (52, None, None, None, None), (53, "12 34", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = common.table(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(12))
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(range(12))
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No documents at all; and nulls, empty texts, repeated rows, a long text and columns with the names that stages use inside."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, row string, text_hash long, kept_id long, grouped boolean, of_id long, rejected string"
    rows = [(i, "\n".join(prose(10 * i + k, 40) for k in range(3)), "en", "s", "r", 1, 2, True, 3, "x") for i in range(8)]
    rows += [(3, rows[3][1], "en", "s", "other", 1, 2, True, 3, "x"), (20, None, None, None, None, None, None, None, None, None), (21, "", "en", "s", "r", 1, 2, False, 3, "x")]
    rows += [(22, prose(500, 120_000), "en", "s", "r", 1, 2, True, 3, "x")]
    for name, found, kept in (("none", [], set()), ("odd", rows, {*range(8), 22})):
        folder = tmp_path / name
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, prose(901, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in cp.STAGES[:-1]:
            docs = common.table(stage(spark, docs, str(folder)), "stage")
            assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
        assert {r["doc_id"] for r in docs.collect()} - {21} == kept
        assert {r["doc_id"] for r in cp.run(spark, str(folder)).collect()} - {21} == kept


def test_leaks_without_their_rarest_words(spark):
    # a paraphrase replaces the rare words (a quarter of an item) and keeps the rest in order
    r = random.Random(5)
    common = [f"frequent{k}" for k in range(400)]
    items = []
    for i in range(8):
        words = [r.choice(common) for _ in range(24)]
        for k in r.sample(range(24), 6):
            words[k] = f"rare{i}x{k}"
        items.append((i, words))
    rows = [(i, " ".join(r.choice(common) for _ in range(200))) for i in range(300)]
    for i, words in items:
        changed = " ".join(f"other{i}y{k}" if w.startswith("rare") else w for k, w in enumerate(words))
        rows.append((1000 + i, f"{prose(40 + i, 48)} {changed} {prose(80 + i, 40)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontam.find_leaks(docs, bench).collect()}
    assert [got[1000 + i] for i, _ in items] == [[i] for i, _ in items]
    assert not any(got[i] for i in range(300))


def test_recall_of_short_lines_at_the_threshold(spark):
    r, pairs = random.Random(11), []
    for _ in range(1500):
        s = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(59))
        pairs.append((s[:54], s[5:]))
        assert jaccard(char_sets(s[:54]), char_sets(s[5:])) == lines.THRESHOLD
    docs = spark.createDataFrame([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    found = sum(x["_n_dropped"] for x in lines.dedup(docs).select("_n_dropped").collect()) / len(pairs)
    print("recall", found)
    assert found >= 0.99


def test_recall_of_lines_of_all_lengths(spark):
    # n shingles on each side, a ninth of them the other's only: a similarity of exactly 0.8
    r, pairs = random.Random(12), []
    for n, count in ((9, 300), (18, 300), (27, 300), (90, 300), (117, 300), (180, 300), (450, 200), (1800, 60)):
        for _ in range(count):
            s = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + n // 9 + 9))
            pairs.append((n, s[: n + 9], s[n // 9 :]))
            assert n > 200 or jaccard(char_sets(pairs[-1][1]), char_sets(pairs[-1][2])) == lines.THRESHOLD
    docs = spark.createDataFrame([(i, f"{a}\n{b}") for i, (_, a, b) in enumerate(pairs)], "doc_id long, text string")
    found = {x["doc_id"]: x["_n_dropped"] for x in lines.dedup(docs).select("doc_id", "_n_dropped").collect()}
    of = lambda n: [found[i] for i, p in enumerate(pairs) if p[0] == n]
    recall = {n: sum(of(n)) / len(of(n)) for n in {p[0] for p in pairs}}
    print("recall", recall)
    assert all(x >= 0.95 for x in recall.values()) and sum(found.values()) / len(pairs) >= 0.98


def test_repetitive_lines_meet_short_ones(spark):
    # few distinct shingles in a long line, which looks at the least hashes only
    rows = [(i, (f"word{i} and " * 200)[: 400 + 40 * i]) for i in range(20)] + [(100 + i, (f"word{i} and " * 4)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {x["doc_id"]: x["_n_dropped"] for x in lines.dedup(docs).collect()}
    sets = {i: char_sets(t) for i, t in rows}
    for i, t in rows:
        assert dropped[i] == int(any(j < i and jaccard(sets[i], sets[j]) >= lines.THRESHOLD for j, _ in rows))


def test_blocks_do_not_change_line_dedup(spark, monkeypatch):
    # a bucket of lines that share a long part and differ from its most frequent line, in pairs of similar ones
    tail = prose(5, 60)
    heads = [prose(100 + i, 25) for i in range(12)]
    rows = [(i, f"{heads[i % 12]} {tail} {'x' * (i // 12)}") for i in range(36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda: sorted((r["doc_id"], r["_n_dropped"]) for r in lines.dedup(docs).collect())
    whole = key()
    monkeypatch.setattr(lines, "BLOCK", 3)
    assert key() == whole and sum(n for _, n in whole) == 24


def test_line_dedup_replaces_own_columns(spark):
    docs = spark.createDataFrame([(1, "a line\na line", 9, "z")], "doc_id long, text string, _n_lines long, n_dropped string")
    out = lines.dedup(docs)
    assert out.columns == ["doc_id", "text", "n_dropped", "_n_lines", "_n_dropped"]
    assert [tuple(r) for r in out.collect()] == [(1, "a line", "z", 2, 1)]


def test_pipeline_join_of_documents_without_ids(spark, tmp_path):
    import corpus_pipeline as cp

    base = prose(1, 150)
    rows = [(None, base, 3), (None, edited(base, 7, 1), 3), (4, base, 1), (4, base, 2), (4, prose(9, 80), 1), (None, "", 1), (None, "", 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.ngram_join(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r["doc_id"], r["text"] == rows[4][1]) for r in kept if r["doc_id"] is not None) == [(4, True)]
    assert sorted(len(r["text"]) > 0 for r in kept if r["doc_id"] is None) == [False, False, True]


def test_pairs_ruled_out_in_bulk_are_no_leaks():
    r = np.random.default_rng(3)
    words, empty = r.integers(0, 300, (80, 24)).astype(np.uint32) * np.uint32(77_777), 0xFFFFFFFF
    asked = np.where(r.random((80, 24)) < 0.2, np.uint32(empty), words[:, r.integers(0, 24, 24)])
    k = r.integers(0, 80, 2000)
    bits, asked_bits = (np.ascontiguousarray(decontam._bits(x, empty).T) for x in (words, asked))
    i = np.where(r.random(2000) < 0.5, k, r.integers(0, 80, 2000))
    doubled = (asked != empty).sum(axis=1) - np.bitwise_count(asked_bits).sum(axis=0)
    assert (decontam._common_bits(bits, i, asked_bits, k) + doubled[k] >= decontam._shared(np.where(asked == empty, 1, asked)[k], words[i])).all()
    items = [r.integers(0, 60, n).astype(np.uint32) for n in (1, 5, 40)]
    flat, tables = r.integers(0, 90, 700).astype(np.uint32), decontam._tables(items)
    first = r.integers(0, 700, 60)
    last, item = np.minimum(first + r.integers(0, 200, 60), 700), r.integers(0, 3, 60)
    for cells in (1, 300, 1 << 20):
        counted = decontam._standing(flat, first, last, item, tables, cells)
        assert counted.tolist() == [int(np.isin(flat[a:b], items[q]).sum()) for a, b, q in zip(first, last, item, strict=True)]
    assert all(n >= decontam.subsequence(items[q], flat[a:b]) for a, b, q, n in zip(first, last, item, counted, strict=True))
    assert not len(decontam._standing(flat, first[:0], last[:0], item[:0], tables))


def test_lines_that_are_not_blank_are_counted_without_reading_each(spark):
    r = random.Random(4)
    texts = ["", None, "\n", "a", " a", "a\n", "a\n b\n\u00a0\n\u2003", "é\nß", "a\r\n\r\nb"] + ["".join(r.choice(["a", "b ", "\n", "\n", " ", "\t", "\r", "\x0b", "\x0c", "\u3000"][: r.choice([3, 10])]) for _ in range(r.randint(0, 8))) for _ in range(400)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lines._filled_lines(F.col("t")).alias("n")).collect()
    assert {x["i"]: x["n"] for x in got} == {i: None if t is None else sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")) for i, t in enumerate(texts)}


def test_a_band_with_an_empty_place_has_no_bucket(spark):
    rows = spark.createDataFrame([(1, 300, 1, 5), (2, 300, 1, 5), (2, 300, 0, 7)], "node long, n int, i int, h long")
    least = lines._count_and_least(rows, [F.when(F.col("h") % 8 == k, F.col("h")).otherwise(F.lit(lines._ALL)) for k in (5, 7, 5) * 8])
    assert {x["node"]: (x["copies"], len(x["buckets"])) for x in lines._buckets(least, 8, 0).collect()} == {1: (1, 0), 2: (1, 8)}


def test_least_hashes_of_places(spark):
    r = random.Random(6)
    rows = [(r.randrange(4), 9, r.randrange(3), r.randrange(1 << 32), r.randrange(6)) for _ in range(60)]
    df = spark.createDataFrame(rows, "node long, n int, i int, h long, place int")
    got = lines._count_and_least(df, [F.col("h")] * 5, "place").collect()
    for x in got:
        own = [y for y in rows if y[0] == x["node"]]
        assert [x[f"m{k}"] for k in range(5)] == [min([y[3] for y in own if y[4] == k], default=lines._ALL) for k in range(5)]
        assert x["copies"] == sum(y[2] == 1 for y in own)
    assert len(got) == len({y[0] for y in rows})


def test_tables_of_a_long_operator_let_the_driver_go(monkeypatch):
    calls = []

    class Df:
        class sparkSession:  # noqa: N801
            class _jvm:  # noqa: N801
                class System:
                    gc = staticmethod(lambda: calls.append(1))

    monkeypatch.setattr(common.storage, "table", lambda df, name: df)
    for _ in range(3 * common.TABLES_TO_LET_GO):
        lines.table(Df(), "any")
    assert len(calls) == 3
