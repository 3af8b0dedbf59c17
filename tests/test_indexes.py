"""Stored indexes against exact forms: words and phrases, nearest vectors, pairs by projection."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import content as C, search as S, vectors as V
from cairnspark.operators.joins import similar_in_blocks


def split(text):
    plain = (text or "").lower().translate({ord(a): b for a, b in C._MARKED.items()})
    return re.findall(r"[^\W_]+", plain)


def ranked(docs, query, k):
    listed = {i: split(t) for i, t in docs}
    n, mean = len(listed), sum(map(len, listed.values())) / len(listed)
    units = {tuple(split(q)) for q in re.findall('"([^"]*)"', query)} | {(w,) for w in split(re.sub('"[^"]*"', " ", query))}
    units.discard(())
    count = lambda t, u: sum(tuple(t[i : i + len(u)]) == u for i in range(len(t)))
    tf = {u: {i: c for i, t in listed.items() if (c := count(t, u))} for u in units}
    hits = set(listed) if units else set()
    for u in units:
        hits &= set(tf[u])
    score = lambda i: -sum(
        max(math.log((n - len(tf[u]) + 0.5) / (len(tf[u]) + 0.5)), 1e-6) * tf[u][i] * 2.2 / (tf[u][i] + 1.2 * (0.25 + 0.75 * len(listed[i]) / mean)) for u in units
    )
    best = sorted((round(score(i), 6), i) for i in hits)[:k]
    return [(i, r) for r, (_, i) in enumerate(best, 1)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = ["the", "of", "Éclair", "Straße", "niño", "x1"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(1, 60)))) for i in range(300)]
    return [*docs, (900, None), (901, ""), (902, "the the the of"), (903, "Of-the THE, of_the")]


def test_content_index(spark, texts):
    index = C.load(spark, C.build(spark.createDataFrame(texts, "id long, text string")))
    assert index.documents == len(texts)
    queries = ["the", "THE of", '"the of"', '"of the" w1', '"the the the"', "eclair", "niño w3", '"straße"', "nowhere the", '"the nowhere"', "", '"" , "', "w1 w1", '"w1" w2 "the of"']
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    found: dict = {}
    for row in C.search(index, asked, 7).collect():
        found.setdefault(row["qid"], []).append((row["id"], row["rank"]))
    for q, query in enumerate(queries):
        assert sorted(found.get(q, []), key=lambda x: x[1]) == ranked(texts, query, 7), query


def test_frequent_terms_fill_parts(spark, texts, monkeypatch):
    monkeypatch.setattr(C, "PART", 10)
    index = C.load(spark, C.build(spark.createDataFrame(texts, "id long, text string")))
    asked = spark.createDataFrame([(1, "the"), (2, '"of the"')], "qid long, query string")
    found = sorted((r["qid"], r["rank"], r["id"]) for r in C.search(index, asked, 5).collect())
    assert found == [(q, r, i) for q, query in ((1, "the"), (2, '"of the"')) for i, r in ranked(texts, query, 5)]


def test_excerpts(spark):
    long = "a" * 150 + " Needle " + "b" * 300
    rows = [(long, "zz needle"), (long, '"Needle bb"'), ("short needle", "needle"), ("x" * 250, "n needle"), ("y" * 10, "q")]
    got = [r["e"] for r in spark.createDataFrame(rows, "t string, q string").select(C.excerpt(F.col("t"), F.col("q")).alias("e")).collect()]
    assert got[0] == got[1] == "..." + long[51:251] + "..." and got[2] == "short needle" and got[3] == "x" * 200 + "..." and got[4] == "y" * 10


@pytest.fixture(scope="module")
def clouds(spark):
    """Vectors around 12 centres, some of them zero, null or repeated."""
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 16))
    rows = [(i, i % 3, (centres[i % 12] + 0.5 * r.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000, 0, [0.0] * 16), (2001, 1, None), (2002, 1, rows[5][2]), (2003, 2, rows[5][2])]
    return spark.createDataFrame(rows, "id long, part long, vec array<double>").cache()


def test_vector_index(spark, clouds):
    index = V.load(spark, V.build(clouds.select("id", "vec")))
    assert index.rows.count() == 1502 and index.sizes.sum() == 1502
    queries = clouds.where("id % 25 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = {tuple(r) for r in S.nearest(clouds.where("vec is not null and id <> 2000"), queries.where("qid <> 2000"), 10).collect()}
    assert {tuple(r) for r in V.nearest(index, queries, 10, exact=True).collect()} == want
    # probes as fitted read a part of the cells and find nearly all
    some = {tuple(r)[:2] for r in V.nearest(index, queries, 10).collect()}
    assert len(some & {w[:2] for w in want}) >= 0.95 * len(want) and index.probes < len(index.centres) / 2
    assert len({q for q, _ in some}) == 60


def test_vector_parts_do_not_change_neighbours(spark, clouds, monkeypatch):
    index = V.load(spark, V.build(clouds.select("id", "vec"), cells=3))
    queries = clouds.where("id % 50 = 0 and id < 2000").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    whole = {tuple(r) for r in V.nearest(index, queries, 5, exact=True).collect()}
    monkeypatch.setattr(V, "PART", 8)
    assert {tuple(r) for r in V.nearest(index, queries, 5, exact=True).collect()} == whole


def test_pairs_by_projection(spark, clouds):
    want = {(r["a"], r["b"]) for r in similar_in_blocks(clouds.where("id <> 2000"), 0.7).collect()}
    found = [(r["a"], r["b"]) for r in V.similar_by_projection(clouds, 0.7, block=64).collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.95 * len(want)
    # right at the threshold
    r = np.random.default_rng(5)
    u, v = r.standard_normal((400, 24)), r.standard_normal((400, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pairs = [(2 * i, i * 2, u[i].tolist()) for i in range(400)] + [(2 * i + 1, i * 2 + 1, (0.7001 * u[i] + np.sqrt(1 - 0.7001**2) * v[i]).tolist()) for i in range(400)]
    near = {(r["a"], r["b"]) for r in V.similar_by_projection(spark.createDataFrame(pairs, "id long, part long, vec array<double>"), 0.7).collect()}
    assert sum((2 * i, 2 * i + 1) in near for i in range(400)) >= 0.93 * 400
    assert V.projection_shape(0.7, 0.95, 8) == 30
