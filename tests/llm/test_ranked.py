"""Ranked search against scores of every document."""

from __future__ import annotations

import math
import random
import re

import duckdb

from cairnspark.llm import ranked, sql

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k):
    listed = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in listed if t), sum(len(t) for _, t in listed)
    df: dict = {}
    for _, t in listed:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc, t in listed:
            score = 0
            for x in words & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                tf = t.count(x)
                score += w * (1000000000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * len(t) * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, r, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, docs, items, k=50):
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    return rows(found)


def test_all_scores(spark, rows):
    """A frequent word, rare ones, ties, and fewer hits than wanted."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(120)], k=n))
    docs = [(i, text(r.choice((3, 20, 200)))) for i in range(700)] + [(900 + i, "w3 w4 Only.Here") for i in range(80)]
    items = [(i, text(12)) for i in range(25)] + [(50, "only"), (51, "here w0 W3"), (52, "nowhere"), (53, "w119 w118 w117")]
    for k in (1, 5, 50):
        assert run(spark, rows, docs, items, k) == plain(docs, items, k)


def test_terms_without_weight_are_no_candidates(spark, rows):
    """A word of all documents weighs too little to count, alone or not."""
    docs = [(i, f"all {'rare' if i % 50 == 0 else 'often'}") for i in range(2000)]
    found = run(spark, rows, docs, [(1, "all"), (2, "all rare")])
    assert found == plain(docs, [(1, "all"), (2, "all rare")], 50) and len(found) == 40


def test_odd_rows(spark, odd_docs, no_docs, rows):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, docs[0][1]), (1, "two"), (2, None), (3, ""), (None, "one " + docs[6][1][:200]), (4, "ÜNÏ ünï \U0001f600"), (5, "x" * 60_000)]
    asked = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, tid long, row long, item long")
    assert rows(ranked.search(odd_docs, asked)) == plain(docs, items, 50)
    assert rows(ranked.search(no_docs, asked)) == [] and rows(ranked.search(odd_docs, asked.limit(0))) == []


def test_bounds_never_pass_the_kth(spark):
    r = random.Random(1)
    values = [(g, int(10 ** r.uniform(0, 7))) for g in range(4) for _ in range(10 + 100 * g)] + [(9, 0)] * 60
    found = {b["g"]: b for b in ranked.kth_bounds(spark.createDataFrame(values, "g long, v long"), "g", "v", 50).collect()}
    for g in (0, 1, 2, 3, 9):
        own = sorted((v for x, v in values if x == g), reverse=True)
        kth = own[49] if len(own) >= 50 else 0
        assert found[g]["df"] == len(own) and found[g]["top"] == own[0]
        assert kth * 31 / 32 <= found[g]["kth"] <= kth


def test_sql(spark, rows):
    duck, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    found = rows(ranked.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert found == sorted(duck.execute(sql.RANKED).fetchall(), key=str)
