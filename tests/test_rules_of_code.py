"""Conditions, modules, use trees, command lines and ignore files, case by case and against plain versions."""

from __future__ import annotations

import random
import shlex

import pytest
from pyspark.sql import functions as F

from cairnspark.functions.shell import shell_split, useful_flags
from cairnspark.operators import conditions as C, modules as M
from cairnspark.sources import ignore as I

ON = {"a", "c"}


def render(node):
    if isinstance(node, tuple):
        return f"{node[0]}({', '.join(map(render, node[1]))})"
    return f'feature = "{node}"' if len(node) == 1 else node


def truth(node):
    if not isinstance(node, tuple):
        return node in ON if len(node) == 1 else True
    values = [truth(x) for x in node[1]] or [True]
    if node[0] == "not":
        return not all(values)
    return any(values) if node[0] == "any" else all(values) if node[0] == "all" else True


def test_nested_conditions(spark):
    r = random.Random(5)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["a", "b", "c", "d", "unix", 'target_os = "linux"'])
        op = r.choice(["all", "any", "not", "version"])
        return op, [made(depth - 1) for _ in range(1 if op == "not" else r.randint(0, 3))]

    trees = [made(4) for _ in range(400)]
    df = spark.createDataFrame([(i, render(t)) for i, t in enumerate(trees)], "i long, c string")
    found = {r["i"]: r["live"] for r in df.select("i", C.is_live(F.col("c"), sorted(ON)).alias("live")).collect()}
    assert found == {i: truth(t) for i, t in enumerate(trees)}


@pytest.mark.parametrize("text,live", [(None, True), ("", True), ('feature = "b"', False), ('not(target_os = "x")', False), ('all(feature = "a", not(feature = "b"))', True), ('any(feature="b"', True), ("all()", True)])
def test_conditions(spark, text, live):
    assert spark.createDataFrame([(text,)], "c string").select(C.is_live(F.col("c"), ["a"]).alias("x")).first()["x"] is live


def test_conditions_of_functions(spark, rows):
    source = (
        'use x;\n#[cfg(feature = "z")]\nmod m {}\n\n#[inline]\n#[cfg(all(feature = "a", not(feature = "b")))]\n#[must_use]\npub(crate) async fn one() {}\n'
        'fn two() {}\n#[cfg(unix)]\n#[cfg(feature = "q")]\nunsafe extern "C" fn three() {}\n#[derive(Debug)]\nfn four() {}\n#[cfg(any(\n  unix,\n  windows\n))]\nfn five() {}\n'
    )
    found = C.function_conditions(spark.createDataFrame([("f", source), ("g", None), ("h", "")], "file string, content string"))
    assert rows(found) == sorted([("f", "one", 'all(feature = "a", not(feature = "b"))'), ("f", "three", 'feature = "q"'), ("f", "five", "any(\n  unix,\n  windows\n)")], key=str)
    blocks = spark.createDataFrame([("f", "one", 1), ("f", "two", 2)], "file string, function string, block long")
    assert {r["block"]: r["condition"] is not None for r in C.inherited(blocks, found).collect()} == {1: True, 2: False}


def test_module_paths(spark):
    cases = {
        "src/lib.rs": "crate", "src/main.rs": "crate", "src/foo.rs": "crate::foo", "src/foo/mod.rs": "crate::foo", "src/foo/bar/mod.rs": "crate::foo::bar",
        "/home/u/p/src/foo/bar.rs": "crate::foo::bar", "a/src/b/src/c.rs": "crate::c", "tests/t.rs": "crate::tests::t", "src/foo/lib.rs": "crate::foo::lib",
    }
    df = spark.createDataFrame(list(cases.items()), "f string, m string")
    assert [r["f"] for r in df.where(M.module_path(F.col("f")) != F.col("m")).collect()] == []


def test_imports(spark):
    files = spark.createDataFrame([(1, "src/lib.rs"), (2, "src/a/mod.rs"), (3, "src/a/b.rs"), (4, "src/c.rs"), (5, "src/a.rs")], "id long, file string")
    asked = [
        (0, "src/a/b.rs", ["crate", "c"], 4), (1, "src/a/b.rs", ["super"], 2), (2, "src/a/b.rs", ["super", "b"], 3), (3, "src/a/b.rs", ["super", "super", "c"], 4),
        (4, "src/a/b.rs", ["super", "super", "super", "c"], None), (5, "src/a/mod.rs", ["self", "b"], 3), (6, "src/c.rs", ["a", "b"], 3), (7, "src/c.rs", ["serde"], None),
        (8, "src/lib.rs", ["super", "c"], None), (9, "src/a/b.rs", ["self", "super", "b"], 3), (10, "src/c.rs", [], None), (11, "src/lib.rs", ["self", "a"], 2), (12, "src/c.rs", ["crate"], 1),
    ]
    found = M.resolve_imports(spark.createDataFrame([a[:3] for a in asked], "import long, file string, path array<string>"), files)
    assert {r["import"]: r["target"] for r in found.collect()} == {a[0]: a[3] for a in asked}
    assert {r["kind"] for r in found.collect()} == {"use_crate", "use_super", "use_self", "plain_use"}


def test_use_trees(spark):
    source = "use a::{b, c::{d, e as f}, self, g::*};\npub(crate) use crate::x::Y as Z;\n// use no::no;\nuse super::*;\nuse ::std::io;\n  use q::{\n    r,\n    s::{t::{u}},\n  };\n"
    found = M.use_statements(spark.createDataFrame([("f", source), ("g", None)], "file string, content string")).orderBy("at")
    got = [("::".join(r["path"]), r["is_glob"], r["kind"]) for r in found.collect()]
    assert got == [
        ("a::b", False, "plain_use"), ("a::c::d", False, "plain_use"), ("a::c::e", False, "plain_use"), ("a", False, "plain_use"), ("a::g", True, "plain_use"),
        ("crate::x::Y", False, "use_crate"), ("super", True, "use_super"), ("std::io", False, "plain_use"), ("q::r", False, "plain_use"), ("q::s::t::u", False, "plain_use"),
    ]


def test_command_lines(spark):
    lines = ['cc -I "a b" -c x.c', "clang -DX='1 2' -I dir -o out.o -isystem /s -O2 -fPIC x.c", "a  b\t c", "", 'x "open end', "-D\"A\"'B'C d", "''", 'g++ -std=c++17 -Iinc -I "q r"/s -o -f -m32']
    df = spark.createDataFrame([(x,) for x in lines], "c string").select("c", shell_split(F.col("c")).alias("w"))
    found = {r["c"]: (r["w"], r["flags"]) for r in df.select("c", "w", useful_flags(F.col("w")).alias("flags")).collect()}
    for x in lines:
        if x != 'x "open end':
            assert found[x][0] == [w for w in shlex.split(x.replace("\\", "")) if w], x
    assert found['x "open end'][0] == ["x", "open end"]
    assert found[lines[0]][1] == ["-I", "a b"] and found[lines[1]][1] == ["-DX=1 2", "-I", "dir", "-isystem", "/s", "-fPIC"]
    assert found[lines[-1]][1] == ["-std=c++17", "-Iinc", "-I", "q r/s", "-m32"]


def test_ignore_files(spark):
    files = [
        ("", 0, "ignored_dir/**\ntarget/\n# note\n\n/only_here.rs\n*.log\n!keep.log\ndocs/*.md\nbuild\n\\#odd\nlogs/**/deep.txt\n"),
        ("", 1, "*.tmp\n"), ("sub", 0, "!build\nsecret.*\n!secret.md\n/top.rs"), ("target", 0, "!*\n"),
    ]
    cases = {
        "src/lib.rs": None, "ignored_dir/code.rs": "ignored_dir/code.rs", "target/lib.rs": "target", "main.tmp": "main.tmp", "a/target/x.rs": "a/target", "target": None,
        "only_here.rs": "only_here.rs", "a/only_here.rs": None, "a/b.log": "a/b.log", "a/keep.log": None, "docs/x.md": "docs/x.md", "docs/a/x.md": None, "a/docs/x.md": None,
        "build": "build", "sub/build": None, "other/build/x.rs": "other/build", "sub/secret.rs": "sub/secret.rs", "sub/secret.md": None, "secret.rs": None, "#odd": "#odd",
        "sub/top.rs": "sub/top.rs", "sub/a/top.rs": None, "logs/deep.txt": "logs/deep.txt", "logs/a/b/deep.txt": "logs/a/b/deep.txt",
    }
    table = I.rules(spark.createDataFrame(files, "folder string, rank long, content string"))
    found = {r["path"]: r["by"] for r in I.ignored(spark.createDataFrame([(p,) for p in cases], "path string"), table).collect()}
    assert found == {p: by for p, by in cases.items() if by}


def test_no_rules(spark):
    table = I.rules(spark.createDataFrame([("", 0, "# none\n\n")], "folder string, rank long, content string"))
    assert I.ignored(spark.createDataFrame([("a/b",)], "path string"), table).isEmpty()
