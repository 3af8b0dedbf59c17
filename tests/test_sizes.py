"""Rows that plans make on the way: joins of frequent names, equal questions."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from cairnspark.functions import content as C, vectors as V
from cairnspark.operators import joins as J, traversal as A
from cairnspark.plans import catalog, search_queries as Q, storage
from cairnspark.sources import rust as R


def most_rows(df):
    """The most rows that one operator of the executed plan gave out."""
    df.collect()

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.getClass().getSimpleName():
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
        return max([own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_qualified_names_that_many_ask_for_and_many_have(spark):
    symbols = spark.range(600).select("id", F.lit("new").alias("name"), F.concat(F.lit("f"), F.col("id") % 7).alias("file"))
    symbols = symbols.withColumn("fqn", F.concat_ws("::", "file", "name"))
    names = spark.range(500).select(F.concat(F.lit("x"), "id", F.lit("::new")).alias("name"), F.concat(F.lit("f"), F.col("id") % 9).alias("file"))
    found = J.resolve_qualified(names, symbols)
    assert most_rows(found) <= 4 * 500
    # the least id of the own file, or of all where the file has none
    assert {(r["file"], r["target"]) for r in found.collect()} == {(f"f{i}", i if i < 7 else 0) for i in range(9)}
    mixed = spark.createDataFrame([("super::f3::new", None), ("crate::new", "f5"), ("f2::new", "f1"), ("none", "f1")], "name string, file string")
    assert {tuple(r) for r in J.resolve_qualified(mixed, symbols).collect()} == {("super::f3::new", None, 3), ("crate::new", "f5", 5), ("f2::new", "f1", 2)}


def test_equal_questions_are_searched_once(spark):
    index = C.load(spark, C.build(spark.range(400).select("id", F.lit("the code").alias("text"))))
    found = C.search(index, spark.range(300).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, "the code").otherwise("CODE, the").alias("query")), 2)
    assert most_rows(found) <= 2000
    assert {tuple(r)[:3] for r in found.collect()} == {(q, i, i + 1) for q in range(300) for i in range(2)}


def test_asked_words_with_sharp_s(spark, tmp_path):
    rows = [(1, "Erßie entech x y"), (2, "Ab entech x y")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "erßie entech y"), (8, "ab entech y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = {r["qid"]: r["query"] for r in Q._asked(spark, str(tmp_path)).collect()}
    assert asked[2] == '"erßie, entech" y' and asked[4] == '"AB, entech" y'
    assert {(r["qid"], r["id"]) for r in Q._hits(spark, str(tmp_path)).collect()} >= {(2, 7), (4, 8)}


def test_references_of_the_asked_only(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 1, [0.0, 1.0]), (4, 0, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 2, None), (7, 2, [0.0, 0.0])], "id long, part int, vec array<float>")
    found = {(r["a"], r["b"]) for r in V.similar_to(rows, spark.createDataFrame([(1,), (3,), (7,)], "id long"), 0.05).collect()}
    assert found == {(1, 2)}


def test_impl_relations_without_modules(spark):
    files = spark.createDataFrame([("a.rs", "mod m { impl T for S { fn f() {} } }\nimpl S {}\n")], "file string, content string")
    plain, whole = R.impl_relations(files, modules=False), R.impl_relations(files)
    assert sorted(map(str, plain.collect())) == sorted(map(str, whole.drop("module").collect())) and len(plain.collect()) == 2


def test_vector_index_over_several_partitions(spark):
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + i)).alias("vec"))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = {tuple(r)[:2] for r in V.nearest(V.load(spark, V.build(rows)), queries, 3, exact=True).collect()}
    finally:
        spark.conf.unset(setting)
    assert found == {tuple(r)[:2] for r in V.nearest_of_all(rows, queries, 3).collect()}


def test_pairs_of_blocks_without_copies_of_vectors(spark):
    rows = spark.range(400).select("id", (F.col("id") % 3).alias("part"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + i)).alias("vec"))
    odd = spark.createDataFrame([(900, None, [1.0] * 8), (901, 1, None), (902, 2, [0.0] * 8)], "id long, part long, vec array<double>")
    found = J.similar_in_blocks(rows.unionByName(odd), 0.99, block=20)
    want = {(r["a"], r["b"]) for r in J.similar_in_blocks(rows, 0.99).collect()}
    assert want and {(r["a"], r["b"]) for r in found.collect()} == want and found.count() == len(want)
    # every vector met a copy of each other block before
    assert most_rows(found) <= 2 * 400


def test_projections_that_would_compare_more_than_all_pairs(spark):
    x = np.random.default_rng(3).standard_normal((300, 64))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, part long, vec array<double>")
    assert V.projection_shape(0.35, 0.99999, 5) >= 1 << 5
    found = V.similar_by_projection(rows, 0.35, recall=0.99999, bits=5)
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = {(i, j) for i, j in zip(*np.nonzero(near >= 0.35), strict=True) if i % 3 < j % 3}
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(want) > 20
    # each vector stood in every table before
    assert most_rows(found) <= 2 * 300


def test_nearest_holds_stripes_of_queries_only():
    near = np.round(np.random.default_rng(1).random((40, 300)), 2)
    i, j, value = V._most(near, 10)
    best = np.argsort(-near, axis=1, kind="stable")[:, :10]
    assert j.tolist() == best.ravel().tolist() and i.tolist() == np.repeat(np.arange(40), 10).tolist() and (value == near[i, j]).all()
    assert len(V._most(near[:, :4], 10)[0]) == 160


def test_nearest_over_several_stripes(spark, monkeypatch):
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.round(F.sin(F.col("id") % 90 * i + i), 1)).alias("vec"))
    queries = rows.where("id % 9 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = {tuple(r) for r in V.nearest_of_all(rows, queries, 5).collect()}
    monkeypatch.setattr(V, "STRIPE", 7)
    assert {tuple(r) for r in V.nearest_of_all(rows, queries, 5).collect()} == want and len(want) == 34 * 5


def test_orphans_of_nodes_with_many_edges(spark):
    edges = spark.range(3000).select((F.col("id") % 3).alias("from_id"), (F.col("id") % 2 + 5).alias("to_id"), F.element_at(F.array(*map(F.lit, ("REFERENCES", "CALLER", "CALLS", "OTHER"))), (F.col("id") % 4 + 1).cast("int")).alias("edge_type"))
    nodes = spark.createDataFrame([(0,), (5,), (6,), (9,)], "id long")
    found = J.orphans(nodes, nodes, edges)
    assert {tuple(r) for r in found.collect()} == {(n, "no target") for n in (5, 6, 9)} | {(n, "no caller") for n in (0, 5, 9)} | {(n, "no callee") for n in (5, 6, 9)}
    # edges come to one row per node before they are sorted for the join
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_nodes_are_sent_to_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert A._sender(edges) is F.broadcast
    monkeypatch.setattr(A, "SENT", 1)
    assert A._sender(edges) is not F.broadcast and {tuple(r) for r in A.cycles(edges).collect()} == {(1, 1), (2, 1)}


def stored(spark):
    """Tables in the shared folder by name."""
    return {f.name for f in Path(storage.shared_dir(spark).removeprefix("file:")).glob("*")}


def test_content_index_is_all_that_is_written(spark):
    before = stored(spark)
    path = C.build(spark.range(400, numPartitions=4).select("id", F.lit("the code, the text").alias("text")))
    # all postings were a table of their own before, and a row each
    assert [n.rsplit("-", 1)[0] for n in stored(spark) - before] == ["content-index"]
    index = C.load(spark, path)
    assert index.blocks.count() <= 4 * 4 and index.documents == 400 and index.mean == 4
    assert {tuple(r) for r in index.terms.collect()} == {("the", 400), ("code", 400), ("text", 400)}
    found = index.of(spark.createDataFrame([("the",), ("none",)], "term string")).collect()
    assert sorted(r["id"] for r in found) == list(range(400)) and {(r["term"], r["length"], tuple(r["positions"])) for r in found} == {("the", 4, (0, 2))}


def test_content_index_in_slices_and_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 7)
    monkeypatch.setattr(C, "PART", 2)
    texts = ["a b a", None, "b", "", "a b c d e f g h i j a b", "...", "b a b a b", "ß a"]
    index = C.load(spark, C.build(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)))
    want = {(w, f"k{i}", len((t or "").split()), tuple(j for j, x in enumerate(t.split()) if x == w)) for i, t in enumerate(texts) if t and t != "..." for w in t.split()}
    got = [tuple(map(lambda v: tuple(v) if isinstance(v, list) else v, r)) for r in index.of(index.terms).collect()]
    assert len(got) == len(want) and set(got) == want and index.blocks.agg(F.max(F.size("ids"))).first()[0] == 2
    assert index.documents == 8 and index.mean == 23 / 8
    none = C.load(spark, C.build(spark.createDataFrame([], "id long, text string")))
    assert none.documents == 0 and none.mean == 0 and none.terms.isEmpty()
    assert C.search(none, spark.createDataFrame([(1, "a")], "qid long, query string"), 3).isEmpty()


def test_phrases_of_three_words(spark):
    rows = [(1, "x y z x y"), (2, "x y x z"), (3, "y z x y z y z"), (4, "x x x x"), (5, "z")]
    index = C.load(spark, C.build(spark.createDataFrame(rows, "id long, text string")))
    phrases = spark.createDataFrame([(0, ["x", "y", "z"]), (1, ["x", "x", "x"]), (2, ["z", "q", "x"]), (3, ["y", "z"])], "u long, unit array<string>")
    assert {tuple(r) for r in C.phrase_hits(index, phrases).collect()} == {(0, 1, 5, 1), (0, 3, 7, 1), (1, 4, 4, 2), (3, 1, 5, 1), (3, 3, 7, 3)}


def test_excerpts_without_a_shuffle_of_texts(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha beta gamma delta"), (2, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "x " * i + "alpha, beta gamma delta") for i in range(7, 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.QUERIES["f2_excerpts"](spark, str(tmp_path))
        rows = {tuple(r) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {(q, "x " * 7 + "alpha, beta gamma delta") for q in (2, 3)}
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_cycles_leave_their_members_only(spark):
    # two rounds: 3 and 4 are reached from the least node, so they have its colour first
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 6)], "src long, dst long")
    before = stored(spark)
    found = A.cycles(edges)
    # edges of each round, colours and what was reached stood there to the end
    assert {n.rsplit("-", 1)[0] for n in stored(spark) - before} == {"components"}
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
