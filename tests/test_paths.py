"""Bounded paths, hop search, budgets, details and Rust relations against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cairnspark.operators import context as C, paths as P, resolve as V
from cairnspark.sources import rust as R


def graph(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def node(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def walk(edges, start, max_depth, exits, visits):
    out: dict = {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
    found, pruned = [], 0

    def go(path):
        nonlocal pruned
        at = path[-1]
        if len(path) >= max_depth:
            pruned += 1
            return
        if exits is not None and at in exits and len(path) > 1:
            found.append(path)
            return
        if not out.get(at) and exits is None and len(path) > 1:
            found.append(path)
        for b in out.get(at, []):
            if path.count(b) < visits:
                go([*path, b])

    go([start])
    return sorted(found, key=lambda p: (len(p), p)), pruned > 0


def test_bounded_paths(spark):
    r = random.Random(3)
    for seed, (exits, visits, most) in enumerate([(None, 1, 100), ({5, 9}, 1, 3), ({0, 3}, 2, 20), (None, 2, 7)]):
        edges = [(r.randint(0, 11), r.randint(0, 11)) for _ in range(16 + 2 * seed)]
        for depth in (1, 2, 5):
            want, hit = walk(edges, 0, depth, exits, visits)
            found, stats = P.enumerate_paths(graph(spark, edges), node(spark, 0), depth, most, node(spark, *exits) if exits else None, visits)
            kept = want[:most]
            assert sorted((list(x["path"]) for x in found.collect()), key=lambda p: (len(p), p)) == kept
            s = stats.first()
            assert (s["total"], s["kept"], s["bound_hit"], s["nodes"]) == (len(want), len(kept), hit, len({x for p in kept for x in p}))
            assert s["average"] == (sum(map(len, kept)) / len(kept) if kept else 0) and s["greatest"] == max(map(len, kept), default=0)


def test_hop_search(spark):
    names = {1: "alpha beta", 2: "alphabet", 3: "caller", 4: "callee", 5: "far", 6: "further", 7: "off"}
    s = spark.createDataFrame(list(names.items()), "id long, name string")
    e = graph(spark, [(3, 2), (2, 4), (4, 5), (5, 6), (2, 1), (3, 7)])
    found = {r["name"]: (r["score"], r["distance"]) for r in P.hop_search(s, e, "alpha", 5, 2).collect()}
    # what the caller of a seed calls is not reached: hops go one way
    assert found == {"alphabet": (1.0, 0), "alpha beta": (0.75, 0), "caller": (0.7, 1), "callee": (0.7, 1), "far": (0.49, 2)}
    assert [r["id"] for r in P.hop_search(s, e, "alpha", 1, 0).collect()] == [2] and P.hop_search(s, e, "zzz", 5, 2).isEmpty()
    assert P.hop_search(s, e, "alphabet", 1, 9).count() == 6  # 1 + max(9 // 2, 5), of as many that are reached


def test_details(spark):
    s = spark.createDataFrame([(i, f"n{i}", "f" if i < 15 else "g") for i in range(20)], "id long, name string, file string")
    e = graph(spark, [(1, 0), (2, 1), (0, 3), (3, 0), (3, 4), (4, 5), (18, 19)])
    rows = P.symbol_details(s, e, spark.createDataFrame([(0,), (19,)], "target long"), depth=2).collect()
    of = lambda t, section: {r["id"]: r["depth"] for r in rows if (r["target"], r["section"]) == (t, section)}
    assert of(0, "caller") == {1: 1, 3: 1, 2: 2} and of(0, "callee") == {3: 1, 4: 2} and list(of(0, "related")) == list(range(1, 11))
    assert of(19, "caller") == {18: 1} and of(19, "callee") == {} and set(of(19, "related")) == {15, 16, 17, 18}


def plain_summary(head, items, tail, tokens, most=15):
    limit, partial = most, len(items) > most
    while True:
        some = items[:limit]
        text = head + ("Entry Points:\n" + "".join(f"  - {x}\n" for x in some) + "\n" if some else "") + tail + (C.PARTIAL if partial else "")
        if len(text.encode()) <= 4 * tokens:
            return text
        if limit == 0:
            return text[: max(4 * tokens - 60, 0)] + C.CUT
        partial, limit = True, limit // 2 if limit > 2 else 0


def test_answers_fit(spark):
    cases = [("P\n", [f"item {i} é" for i in range(n)], "end\n", t) for n in (0, 1, 2, 9, 40) for t in (0, 5, 20, 25, 40, 60, 90, 400)]
    df = spark.createDataFrame(cases, "head string, items array<string>, tail string, tokens int")
    found = df.select("*", C.fitted_summary(F.col("head"), F.col("items"), F.col("tail"), F.col("tokens")).alias("answer")).collect()
    kinds = set()
    for r in found:
        assert r["answer"] == plain_summary(r["head"], r["items"], r["tail"], r["tokens"]), (len(r["items"]), r["tokens"])
        kinds.add(r["answer"].count("  - "))
    assert {0, 1, 3, 7, 9, 15} <= kinds


def test_symbol_answers_halve_source_first(spark):
    source, callers = "\n".join(f"line {i}" for i in range(60)), [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([(source, callers, callers[:2], t) for t in (400, 160, 75, 45, 30, 1)], "source string, callers array<string>, callees array<string>, tokens int")
    rows = df.select("tokens", C.fitted_symbol(F.lit("s\n"), F.col("source"), F.col("callers"), F.col("callees"), F.col("tokens")).alias("a")).collect()
    shape = {r["tokens"]: (r["a"].count("line "), r["a"].count("  - ")) for r in rows}
    assert shape[400] == (40, 17) and shape[160] == (40, 17) and shape[75] == (10, 17)
    assert shape[45][0] == 0 and all(len(r["a"]) <= max(4 * r["tokens"], 60) or r["tokens"] == 1 for r in rows)


def test_rust_relations(spark, rows):
    source = (
        '// impl No for Comment {\nstruct S<T>(T);\ntrait T1 { fn f(); }\n/* impl No {\n */\nmod a {\n  mod b {\n    impl<T: Into<Vec<u8>>> super::T1 for S<T> where T: X {\n'
        '      fn f() { let s = "impl No for Str {"; let c = \'{\'; let r = r#"impl No { "# ; if x { y() } }\n    }\n  }\n  impl S<u8> {}\n}\n#[cfg(any(unix))]\nunsafe impl Send for S<u8> {}\n'
        "impl !Sync for S<u8> {}\nfn g() -> impl Fn(u8) -> u8 { |x| x }\nimpl T1 for S<u8> {}\n"
    )
    found = R.impl_relations(spark.createDataFrame([("f", source), ("g", None), ("h", "")], "file string, content string"))
    assert rows(found) == sorted(
        [("f", 8, "a::b", "S", "super::T1"), ("f", 12, "a", "S", None), ("f", 15, "", "S", "Send"), ("f", 16, "", "S", "Sync"), ("f", 18, "", "S", "T1")], key=str
    )
    known = spark.createDataFrame([(3, "f", "S"), (2, "f", "S"), (5, "f", "T1"), (9, "other", "Send")], "id long, file string, name string")
    assert rows(R.implements(found, known)) == [(2, 5, "IMPLEMENTS")]


def test_paths_resolve_in_stages(spark):
    stored = [(1, "src/a.rs"), (2, "/w/lib/b.rs"), (3, "x/same.rs"), (4, "y/same.rs"), (5, "/here/c.rs"), (6, "./d//e.rs"), (7, "src/a.rs")]
    asked = {
        "src/a.rs": (1, 1), "lib/b.rs": (2, 2), "/w/src/a.rs": (1, 3), "c.rs": (5, 4), "/else/d/e.rs": (6, 5), "e.rs": (6, 5), "b.rs": (2, 5), "same.rs": None, "x/same.rs": (3, 1),
        "d/../d/e.rs": (6, 1), "ame.rs": None, "": None, "/w": None, "/else/w/lib/b.rs": None, "a.rs": (1, 5),
    }
    found = V.resolve_paths(spark.createDataFrame(stored, "id long, path string"), spark.createDataFrame([(q,) for q in [*asked, None]], "query string"), "/w", "/here")
    assert {r["query"]: (r["id"], r["stage"]) for r in found.collect()} == {q: v for q, v in asked.items() if v}
    without = V.resolve_paths(spark.createDataFrame(stored, "id long, path string"), spark.createDataFrame([("lib/b.rs",)], "query string"))
    assert [(r["id"], r["stage"]) for r in without.collect()] == [(2, 5)]


def test_references_between_projects(spark, rows):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (4, 2, 0.7)], "a long, b long, cosine double")
    known = spark.createDataFrame([(1, "p", "f"), (2, "q", "f"), (3, "r", "g"), (4, "r", "f")], "id long, project string, name string")
    both = V.cross_references(pairs)
    asked = spark.createDataFrame([(1,), (2,), (9,)], "symbol long")
    assert rows(V.analogues(both, known, asked, limit=1)) == [(1, 2, "q", "f", 0.9, 1), (2, 1, "p", "f", 0.9, 1)]
    assert rows(V.analogues(both, known, asked, project="r")) == [(1, 3, "r", "g", 0.8, 1), (2, 4, "r", "f", 0.7, 1)]
    assert rows(V.compared_projects(both, known, "f", ["p", "q", "r"])) == [("p", 1, 2, 0.9), ("q", 2, 2, 0.9), ("r", 4, 2, 0.7)]
