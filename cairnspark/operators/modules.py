"""Rust modules: files as module paths, imports resolved against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def module_path(file: Column) -> Column:
    """The module of a file: what follows the last src/ without .rs, parts named mod left out, under crate; src/lib.rs and
    src/main.rs are crate itself."""
    inner = F.regexp_replace(F.regexp_replace(file, r"(?s)^(?:.*[/\\]src[/\\]|src/)", ""), r"\.rs$", "")
    parts = F.filter(F.split(inner, "/"), lambda p: p != "mod")
    root = (F.size(parts) == 1) & F.get(parts, F.lit(0)).isin("lib", "main")
    return F.when(root, "crate").otherwise(F.concat(F.lit("crate::"), F.array_join(parts, "::")))


def import_kind(path: Column) -> Column:
    """Kind of an import by the first part of its path (fixed values)."""
    first = F.get(path, F.lit(0))
    return F.when(first == "crate", "use_crate").when(first == "super", "use_super").when(first == "self", "use_self").otherwise("plain_use")


def wanted_module(file: Column, path: Column) -> Column:
    """The module that an import path (array) means in a file: crate from the root, self from the file's module, each super one up
    (null above the root), any other path from the root. Null for an empty path."""
    home = F.split(module_path(file), "::")
    relative = F.get(path, F.lit(0)).isin("self", "super")
    plain = F.filter(path, lambda p, i: ~((i == 0) & (p == "self")))
    # super counts only before the first other part
    run = F.aggregate(plain, F.struct(F.lit(0).alias("n"), F.lit(True).alias("going")), lambda acc, p: F.struct(
        (acc["n"] + F.when(acc["going"] & (p == "super"), 1).otherwise(0)).alias("n"), (acc["going"] & (p == "super")).alias("going")
    ))["n"]
    up = F.concat(F.slice(home, F.lit(1), F.greatest(F.size(home) - run, F.lit(0))), F.slice(plain, run + 1, F.size(plain)))
    absolute = F.when(F.get(path, F.lit(0)) == "crate", path).otherwise(F.concat(F.array(F.lit("crate")), path))
    parts = F.when(relative, F.when(run < F.size(home), up)).otherwise(absolute)
    return F.when(F.size(path) > 0, F.array_join(parts, "::"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (import, file, path array, ...) with kind, the module that is meant and target: the id of the file of that module (the
    least of several), null where none is. One equi left join on the module; files are (id, file)."""
    index = files.groupBy(module_path(F.col("file")).alias("module")).agg(F.min("id").alias("target"))
    asked = imports.withColumns({"kind": import_kind(F.col("path")), "module": wanted_module(F.col("file"), F.col("path"))})
    return asked.join(index, "module", "left")


def leaf_paths(tree: Column) -> Column:
    """Paths of a use tree, a::{b, c::{d, e as f}, self, g::*}: one per leaf, without aliases; self at the end stands for its prefix."""
    parts = F.regexp_extract_all(F.regexp_replace(tree, r"\s+as\s+\w+", ""), F.lit(r"[{},]|[^{},\s]+"), 0)
    kind = "struct<open:array<string>,last:string,out:array<string>>"

    def step(acc: Column, part: Column) -> Column:
        prefix = F.coalesce(F.element_at(acc["open"], -1), F.lit(""))
        emitted = F.when(acc["last"].isNotNull(), F.array_append(acc["out"], acc["last"])).otherwise(acc["out"])
        state = lambda opened, last, out: F.struct(opened.alias("open"), last.alias("last"), out.alias("out"))
        none = F.lit(None).cast("string")
        return (
            F.when(part == "{", state(F.array_append(acc["open"], F.coalesce(acc["last"], prefix)), none, acc["out"]))
            .when(part == "}", state(F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1), none, emitted))
            .when(part == ",", state(acc["open"], none, emitted))
            .otherwise(state(acc["open"], F.concat(prefix, part), acc["out"]))
        )

    none = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit(None).cast("string").alias("last"), none.alias("out")).cast(kind)
    done = F.aggregate(parts, start, lambda acc, p: step(acc, p).cast(kind))
    out = F.when(done["last"].isNotNull(), F.array_append(done["out"], done["last"])).otherwise(done["out"])
    return F.transform(out, lambda p: F.regexp_replace(p, "(?<=.)::self$", ""))


def use_statements(files: DataFrame) -> DataFrame:
    """Imports of Rust files (file, content): file, at (place in the file), path array, name, is_glob, kind; nested braces give a row
    each, and a glob's path ends before the star. Text in line comments is not looked at."""
    code = F.regexp_replace("content", r"//[^\n]*", "")
    found = F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"), 1)
    rows = files.select("file", F.posexplode(found).alias("statement", "tree"))
    leaves = rows.select("file", "statement", F.posexplode(leaf_paths(F.col("tree"))).alias("leaf", "spelled"))
    parts = F.filter(F.split(F.regexp_replace("spelled", "^::", ""), "::"), lambda p: ~p.isin("", "*"))
    made = leaves.select("file", F.struct("statement", "leaf").alias("at"), parts.alias("path"), F.element_at(parts, -1).alias("name"), F.col("spelled").endswith("*").alias("is_glob"))
    return made.withColumn("kind", import_kind(F.col("path")))
