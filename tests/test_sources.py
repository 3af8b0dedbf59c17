"""Sources, text functions and streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from cairnspark.functions import text as X
from cairnspark.operators import lookup as L
from cairnspark.sources import files as S, formats as R, python_code as P
from cairnspark.streaming import watch as W


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_scan_and_skip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("def f():\n    g()\n")
    (tmp_path / "y.txt").write_text("no")
    found = S.scan(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").collect()
    assert {r["name"] for r in found} == {"x.py", "y.txt"}
    assert one(spark, S.skip_reason, "a/node_modules/x.js") == "internal"
    assert one(spark, S.skip_reason, "a/x.RS") == "unsupported"
    assert one(spark, S.skip_reason, "a/x.rs") is None
    assert one(spark, lambda c: S.skip_reason(c, include=["src/*"]), "a/x.rs") == "not included"


def test_python_facts(spark, rows):
    source = "class A:\n    def m(self):\n        return helper()\n\ndef helper():\n    return 1\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", "def broken("), ("c.py", None)], "file string, content string")
    found = P.facts(files).cache()
    symbols = {(r["kind"], r["name"]) for r in found.where("fact = 'symbol'").collect()}
    assert symbols == {("Class", "A"), ("Method", "A.m"), ("Function", "helper")}
    assert [r["file"] for r in found.where("fact = 'error'").collect()] == ["b.py"]
    assert rows(P.call_edges(found)) == [("a.py", "A.m", "a.py", "helper")]


def test_lcov(spark, rows):
    text = "SF:a.rs\nDA:1,5\nDA:2,0\nDA:1,7\nBRDA:2,0,0,-\nBRDA:2,0,0,3\nBRDA:2,0,1,-1\nend_of_record\nSF:b.rs\nDA:1,1\nend_of_record"
    hits, branches = R.lcov(R.numbered_lines(spark.createDataFrame([("f", text)], "file string, content string")))
    assert rows(hits) == [("a.rs", 1, 7), ("a.rs", 2, 0), ("b.rs", 1, 1)]
    assert rows(branches) == [("a.rs", 2, 0, "0", 3), ("a.rs", 2, 0, "1", 0)]


def test_mir_and_llvm(spark, rows):
    mir = "fn add(_1: i32) -> i32 {\n    let x;\n    bb0: {\n        _2 = _1;\n        switchInt(_2) -> [0: bb1, otherwise: bb2];\n    }\n    bb1: {\n        return;\n    }\n    bb2: {\n        goto -> bb1;\n    }\n}"
    blocks = R.mir_blocks(R.numbered_lines(spark.createDataFrame([("f", mir)], "file string, content string")))
    assert rows(blocks) == [("f", "add", 0, "conditional", [1, 2]), ("f", "add", 1, "return", []), ("f", "add", 2, "fallthrough", [1])]
    ir = 'define i32 @main() {\nentry:\n  %r = call i32 @helper(i32 1)\n  br i1 %c, label %a, label %b\na:\n  ret i32 0\nb:\n  unreachable\n}\n'
    ends, calls = R.llvm_facts(R.numbered_lines(spark.createDataFrame([("f", ir)], "file string, content string")))
    assert rows(ends) == [("f", "main", "a", "return", []), ("f", "main", "b", "unreachable", []), ("f", "main", "entry", "conditional", ["a", "b"])]
    assert rows(calls) == [("f", "main", "helper")]
    ir = "define void @g() {\n  switch i32 %x, label %d [\n    i32 0, label %a\n    i32 1, label %b\n  ]\na:\n  %v = invoke i32 @may()\n    to label %b unwind label %e\nb:\n  br label %d\nd:\n  ret void\ne:\n  resume { i8* } %z\n}\n"
    ends, calls = R.llvm_facts(R.numbered_lines(spark.createDataFrame([("f", ir)], "file string, content string")))
    found = {r["label"]: (r["terminator"], r["targets"]) for r in ends.collect()}
    assert found == {"entry": ("conditional", ["d", "a", "b"]), "a": ("call", ["b", "e"]), "b": ("fallthrough", ["d"]), "d": ("return", []), "e": ("return", [])}
    assert rows(calls) == [("f", "g", "may")]


def test_imports_lsif_flags(spark, rows, tmp_path):
    rust = "use std::fs::{read, write};\nuse crate::a::*;\nmod inner;\n"
    found = R.rust_imports(spark.createDataFrame([("f", rust)], "file string, content string"))
    assert sorted(("::".join(r["path"]), r["is_glob"]) for r in found.collect()) == [("crate::a::*", True), ("inner", False), ("std::fs::read", False), ("std::fs::write", False)]
    dump = tmp_path / "d.lsif"
    dump.write_text("\n".join(json.dumps(x) for x in ({"type": "vertex", "label": "package", "name": "p"}, {"type": "vertex", "label": "document"}, {"type": "edge", "label": "contains"})))
    assert rows(R.lsif_summary(spark, str(dump))) == [("p", 1, 0)]
    commands = tmp_path / "compile_commands.json"
    commands.write_text(json.dumps([{"directory": "/", "file": "a.c", "command": "cc -Iinc -DX=1 -I 'a b' -O2 -c a.c"}]))
    assert rows(R.compile_flags(spark, str(commands))) == [("/a.c", ["-Iinc", "-DX=1", "-I", "a b"])]
    dump.write_text(json.dumps({"type": "vertex", "label": "document"}))
    with pytest.raises(Exception, match="no package"):
        R.lsif_summary(spark, str(dump)).collect()


def test_text_functions(spark):
    page = "---\ntitle: Hello\ntags: x\n---\n# Other\n[[a|b]] [[a]] #tag #fff\n"
    assert one(spark, X.title, page) == "Hello"
    assert one(spark, X.title, "x\n# Head\n") == "Head"
    assert one(spark, X.title, "nothing") is None
    assert one(spark, X.wikilinks, page) == ["a"]
    assert one(spark, X.tags, page) == ["x", "tag"]  # those of the front matter come first
    assert one(spark, X.terms, "Where does the fn Parse_args a_ parse_ARGS go") == ["does", "Parse_args", "a_"]  # "does" is no stop word
    assert one(spark, L.normal_path, "./a//b/../c/.") == "a/c"
    assert one(spark, L.climbs, "a/../../b") is True
    assert one(spark, lambda c: L.is_live(c, ["x"]), 'any(feature = "x", feature = "y")') is True
    assert one(spark, lambda c: L.is_live(c, ["x"]), 'not(feature = "x")') is False
    assert one(spark, X.language_of, "a/b.tsx") == "typescript"


def events(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, at + dt.timedelta(seconds=s), s) for k, s in rows], "key string, ts timestamp, s long")


def test_sessions_match_the_replay(spark, tmp_path):
    log = [("a", 0), ("a", 5), ("a", 40), ("b", 3), ("a", 51), ("a", 62)]
    batch = events(spark, log)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = W.debounced(stream, "10 seconds", "1 minute").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    live = sorted((r["key"], r["n"]) for r in spark.table("sessions").collect())
    replay = batch.select("key", F.unix_seconds("ts").alias("at"), F.col("s").alias("id"))
    again = sorted((r["key"], r["n"]) for r in W.debounced_replay(replay, 10).collect())
    # event time ends a session before the gap is over, the replay when it is: the same except at the boundary
    assert live == again == [("a", 1), ("a", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_states_are_kept(spark, tmp_path, rows):
    first = spark.createDataFrame([("a", 1, "h1"), ("b", 1, "h1"), ("a", 2, "h2")], "path string, n long, hash string")
    first.write.parquet(str(tmp_path / "in"))
    run = lambda: W.keep_states(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), "path", ["n"], "hash").awaitTermination()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out" / "version=0"))) == [("a", 2, "h2"), ("b", 1, "h1")]
    spark.createDataFrame([("b", 3, None), ("c", 3, "h9")], first.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out" / "version=1"))) == [("a", 2, "h2"), ("c", 3, "h9")]


def test_projects_are_appended_once(spark, tmp_path, rows):
    schema = "path string, kind string"
    put = lambda project, part, *names: spark.createDataFrame([(n, "modify") for n in names], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/{project}")
    put("one", 0, "a", "b")
    put("two", 0, "a")

    def run():
        streams = {p: W.event_files(spark, f"file://{tmp_path}/{p}", schema, files=1) for p in ("one", "two")}
        W.append(W.of_projects(streams), f"file://{tmp_path}/log", f"file://{tmp_path}/ck-log").awaitTermination()
        return rows(spark.read.parquet(f"file://{tmp_path}/log").select("project", "path"))

    assert run() == [("one", "a"), ("one", "b"), ("two", "a")]
    put("two", 1, "c")
    assert run() == [("one", "a"), ("one", "b"), ("two", "a"), ("two", "c")] == run()


def test_keys_of_one_stretch_of_time(spark):
    at = dt.datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("b", at), ("a", at), ("a", at), ("c", at + dt.timedelta(minutes=5))], "key string, end timestamp")
    assert sorted(r["keys"] for r in W.batch_form(sessions).collect()) == [["a", "b"], ["c"]]


def test_tree_of_python(spark, rows):
    text = "import os\n\n@wrap\ndef f(a):\n    for x in a:\n        x.g(os)\n\nclass K:\n    def g(self):\n        return f(self.g)\n"
    deep = "x = " + "-" * 3000 + "1\n"
    files = spark.createDataFrame([("m.py", text), ("bad.py", "def ("), ("none.py", None), ("empty.py", "")], "file string, content string")
    tree = P.nodes(files)
    assert [r["line"] for r in P.printed(tree).orderBy("node").collect()] == [
        "Import [1-1]", "FunctionDef f [4-6]", "  For [5-6]", "    Call [6-6]", "ClassDef K [8-10]", "  FunctionDef g [9-10]", "    Return [10-10]", "      Call [10-10]",
    ]
    assert [r["kind"] for r in P.children(tree, "m.py", None).collect()] == ["Import", "FunctionDef", "ClassDef"]
    assert [r["name"] for r in P.children(tree, "m.py", 4).collect()] == ["g"]
    found = P.references(files, P.facts(files)).select("name", "line", "col", "symbol")
    assert rows(found) == [("f", 10, 15, "f"), ("g", 6, 10, "K.g")]
    assert P._nodes("deep.py", deep) in ([], [("deep.py", 0, None, 0, "Assign", None, 1, 0, 1, len(deep) - 1)])
