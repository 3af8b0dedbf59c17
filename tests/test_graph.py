"""Graph operators on hand-made graphs."""

from __future__ import annotations

import pytest

from cairnspark.operators import answers as N, joins as J, metrics as M, temporal as T, traversal as A

DIAMOND = [("main", "a"), ("main", "b"), ("a", "shared"), ("b", "shared")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_reach(spark, rows):
    found = A.reach(edges(spark, DIAMOND), nodes(spark, "main"))
    assert rows(found) == [("a", 1), ("b", 1), ("main", 0), ("shared", 2)]
    back = A.reach(A.flipped(edges(spark, DIAMOND)), nodes(spark, "shared"), 1)
    assert rows(back) == [("a", 1), ("b", 1), ("shared", 0)]


def test_reach_on_a_chain(spark):
    chain = edges(spark, [(f"f{i:03}", f"f{i + 1:03}") for i in range(30)])
    assert A.reach(chain, nodes(spark, "f000")).count() == 31


def test_reach_without_edges(spark, rows):
    assert rows(A.reach(edges(spark, DIAMOND).limit(0), nodes(spark, "x"))) == [("x", 0)]


def test_dead(spark, rows):
    graph = [("main", "a"), ("a", "shared"), ("unused", "shared")]
    dead = A.dead(edges(spark, graph), nodes(spark, "main"))
    assert rows(dead) == [("unused",)]
    reached = {r["node"] for r in A.reach(edges(spark, graph), nodes(spark, "main")).collect()}
    assert reached | {"unused"} == {x for e in graph for x in e}


def test_blast(spark):
    files = spark.createDataFrame([(n, n[0]) for n in ("main", "a", "b", "shared")], "node string, file string")
    row = A.blast(edges(spark, DIAMOND), files, nodes(spark, "shared")).first()
    assert (row["direct"], row["transitive"], row["score"], row["level"]) == (2, 1, 2.5, "LOW")


@pytest.mark.parametrize(
    ("pairs", "expect"),
    [
        ([("a", "b"), ("b", "a"), ("c", "a")], [("a", "a"), ("b", "a")]),
        ([("a", "a"), ("a", "b")], []),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")], [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]),
        ([("b", "a"), ("a", "c"), ("c", "b"), ("x", "y")], [("a", "a"), ("b", "a"), ("c", "a")]),
    ],
)
def test_cycles(spark, rows, pairs, expect):
    assert rows(A.cycles(edges(spark, pairs))) == expect


def test_condense_is_acyclic(spark, rows):
    members, between = A.condense(edges(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("b", "d")]))
    assert rows(members) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
    assert rows(between) == [("a", "d"), ("c", "a")]
    assert A.cycles(between).count() == 0


def test_paths(spark):
    found = {tuple(r["path"]) for r in A.simple_paths(edges(spark, DIAMOND), nodes(spark, "main"), 4).collect()}
    assert found == {("main", "a", "shared"), ("main", "b", "shared")}


def test_range_join_finds_each_pair_once(spark, rows):
    points = spark.createDataFrame([(1, 5), (1, 64), (1, 200)], "k long, at long")
    ranges = spark.createDataFrame([(1, 0, 1000, 1), (1, 60, 64, 2), (1, 64, 64, 3), (2, 0, 9, 4)], "k long, s long, e long, id long")
    found = J.range_join(points, ranges, ["k"], "at", "s", "e").select("at", "id")
    assert rows(found) == sorted([(5, 1), (64, 1), (64, 2), (64, 3), (200, 1)], key=str)
    best = J.best_range(points, ranges, ["k"], "at", "s", "e", "id").select("at", "id")
    assert rows(best) == sorted([(5, 1), (64, 3), (200, 1)], key=str)


def test_lineages_use_positions(spark, rows):
    versions = spark.createDataFrame([("x", 1), ("x", 5), ("y", 1), ("y", 9)], "k string, snapshot_id long")
    snapshots = spark.createDataFrame([(1,), (5,), (9,)], "snapshot_id long")
    assert rows(T.lineages(versions, ["k"], snapshots)) == [("x", 1, 5, 2, 0), ("y", 1, 9, 2, 1)]


def test_snapshot_cycles(spark, rows):
    graph = spark.createDataFrame([(1, 10, 11), (1, 11, 10), (2, 10, 11), (2, 11, 10), (3, 10, 11)], "snapshot_id long, src long, dst long")
    assert rows(T.snapshot_cycles(graph)) == [(1, 10, 10), (1, 11, 10), (2, 10, 10), (2, 11, 10)]


def test_ranks_are_unique_and_break_ties(spark, rows):
    scored = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "id long, score double")
    got = {r["id"]: r["rank"] for r in M.ranked(scored, "score", "id", 4).collect()}
    order = sorted(range(50), key=lambda i: (-(i % 3), i))
    assert [got[i] for i in order] == list(range(1, 51))


def test_greedy_batches(spark, rows):
    files = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 9), (1, 3, 30), (1, 4, 1)], "project long, seq long, size long")
    assert [r["batch"] for r in M.greedy_batches(files, 10).orderBy("seq").collect()] == [0, 0, 1, 2, 3]


def test_orphans_and_compare(spark, rows):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    two = spark.createDataFrame([(2, "b"), (3, "x"), (4, "y")], "k long, v string")
    assert [(r[0], r[3]) for r in sorted(J.compared(one, two, ["k"], "v").collect())] == [(1, "missing"), (2, "ok"), (3, "changed"), (4, "extra")]


def test_asked_names_and_routes(spark, rows):
    asked = [(1, "Who calls 'Run'?"), (2, 'callees of ""'), (3, ""), (4, None), (5, "find \"A b\" now"), (6, "who calls x")]
    questions = spark.createDataFrame(asked, "ask long, question string")
    named = {r["ask"]: r["name"] for r in questions.select("ask", N.asked_name(questions["question"]).alias("name")).collect()}
    assert named == {1: "run", 2: '""', 3: None, 4: None, 5: "a b", 6: "x"}
    found = spark.createDataFrame([("run", 7), ("run", 8), ("x", 9)], "name string, answer long")
    assert rows(N.routed(questions, {"callers": lambda q: q.join(found, "name")})) == [(1, "callers", 7), (1, "callers", 8), (6, "callers", 9)]


def test_packets(spark, rows):
    tasks = spark.createDataFrame([(1, "repair b_x then b_x and a_x"), (2, ""), (3, None), (4, "unknown_x")], "task long, text string")
    named = spark.createDataFrame([(10, "a_x"), (11, "b_x"), (12, "b_x"), (13, "c")], "id long, name string")
    calls = spark.createDataFrame([(10, 11), (11, 13), (13, 10), (13, 13)], "src long, dst long")
    got = rows(N.packets(tasks, named, calls, top=1))
    assert got == sorted([(1, 11, "find", 11, 0), (1, 11, "caller", 10, 1), (1, 11, "callee", 13, 1), (1, 11, "impact", 10, 1), (1, 11, "impact", 13, 2), (1, 11, "affected", 13, 1), (1, 11, "affected", 10, 2)])
    assert rows(N.packets(tasks.limit(0), named, calls)) == []


def test_swept(spark, rows):
    files = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (4, "a", "x"), (4, "b", None), (7, "a", "x"), (7, "b", None)], "snapshot_id long, path string, hash string")
    chosen = files.select("snapshot_id").where("snapshot_id <> 2")
    assert [tuple(r) for r in N.swept(files, chosen).orderBy("snapshot_id", "path").collect()] == [(1, "a", "x", False), (4, "a", "x", True), (4, "b", None, False), (7, "a", "x", True), (7, "b", None, False)]
