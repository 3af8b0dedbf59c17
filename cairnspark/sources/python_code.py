"""Facts of Python files: symbols, calls, references and the tree, by the standard library's parser in tasks."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_NODES = "file string, node long, parent long, depth long, kind string, name string, start_line long, start_col long, end_line long, end_col long"
#: What the parser raises for text that it can't read, or that nests too deeply for it.
UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
#: Kinds of tree nodes that give a file its structure.
STRUCTURE = (
    "FunctionDef AsyncFunctionDef ClassDef Lambda If For AsyncFor While Try TryStar With AsyncWith Match match_case ExceptHandler "
    "Return Raise Break Continue Assign AugAssign AnnAssign Import ImportFrom Call Assert Yield YieldFrom Await"
).split()
_FACTS = "file string, fact string, kind string, name string, holder string, start_line long, end_line long"


def _facts(path: str, source: str) -> list[tuple]:
    """(file, symbol | call, kind, name, holder, start_line, end_line); a file that doesn't parse gives one error row."""
    try:
        tree = ast.parse(source)
    except UNREADABLE as e:
        return [(path, "error", type(e).__name__, str(e).split("\n")[0][:200], None, None, None)]
    out: list[tuple] = []
    # a stack, for trees deeper than Python's own calls go
    waiting: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while waiting:
        node, holder, in_class = waiting.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            name = f"{holder}.{node.name}" if holder else node.name
            out.append((path, "symbol", "Class" if is_class else "Method" if in_class else "Function", name, holder, node.lineno, node.end_lineno))
            holder, in_class = name, is_class
        elif isinstance(node, ast.Call):
            f = node.func
            called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if called:
                out.append((path, "call", "Call", called, holder, node.lineno, node.end_lineno))
        waiting += [(child, holder, in_class) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _nodes(path: str, source: str) -> list[tuple]:
    """The structural nodes of a file in order of the text, numbered from 0; the parent is the nearest structural node around."""
    try:
        tree = ast.parse(source)
    except UNREADABLE:
        return []
    out: list[tuple] = []
    # a stack, for trees deeper than Python's own calls go
    waiting: list[tuple[ast.AST, int | None, int]] = [(tree, None, 0)]
    while waiting:
        node, parent, depth = waiting.pop()
        if type(node).__name__ in STRUCTURE:
            place = [getattr(node, a, None) for a in ("lineno", "col_offset", "end_lineno", "end_col_offset")]
            out.append((path, len(out), parent, depth, type(node).__name__, getattr(node, "name", None), *place))
            parent, depth = len(out) - 1, depth + 1
        waiting += [(child, parent, depth) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _names(path: str, source: str) -> list[tuple]:
    """Names and attributes that a file reads: (file, name, line, col), col in bytes of the line."""
    try:
        tree = ast.parse(source)
    except UNREADABLE:
        return []
    read = ((n, n.id if isinstance(n, ast.Name) else n.attr) for n in ast.walk(tree) if isinstance(n, ast.Name | ast.Attribute) and isinstance(n.ctx, ast.Load))
    # an attribute's name ends where the node ends
    return [(path, name, n.end_lineno, n.end_col_offset - len(name.encode())) for n, name in read]


def _each_file(files: DataFrame, parse: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    whole = {c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith(" long")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [x for path, text in zip(f["file"], f["content"], strict=True) if text is not None for x in parse(path, text)]
            yield pd.DataFrame(rows, columns=names).astype(whole)

    return files.select("file", "content").mapInPandas(run, schema)


def nodes(files: DataFrame) -> DataFrame:
    """Structural tree nodes of files (file, content): file, node, parent (null for a root), depth, kind, name, lines and columns.

    Null content, and a file that doesn't parse, has none.
    """
    return _each_file(files, _nodes, _NODES)


def children(tree: DataFrame, file: str, node: int | None) -> DataFrame:
    """Nodes right below a node of a file; its roots where node is None."""
    return tree.where((F.col("file") == file) & F.col("parent").eqNullSafe(F.lit(node))).orderBy("node")


def printed(tree: DataFrame) -> DataFrame:
    """A line for each node in order of the text, indented by depth: file, node, line."""
    text = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.concat_ws(" ", "kind", "name"), F.format_string(" [%d-%d]", "start_line", "end_line"))
    return tree.select("file", "node", text.alias("line"))


def references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names that files (file, content) read, matched to symbols (symbol facts) by simple name: file, name, line, col, symbol_file, symbol.

    A name inside the lines of the symbol itself, in its file, is no reference to it.
    """
    known = symbols.where("fact = 'symbol'").select(
        F.col("file").alias("symbol_file"), F.col("name").alias("symbol"), F.element_at(F.split("name", r"\."), -1).alias("name"), "start_line", "end_line"
    )
    found = _each_file(files, _names, "file string, name string, line long, col long").join(known, "name")
    within = (F.col("file") == F.col("symbol_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return found.where(~within).select("file", "name", "line", "col", "symbol_file", "symbol")


def facts(files: DataFrame) -> DataFrame:
    """Symbols and calls of files (file, content); null content has none."""
    return _each_file(files, _facts, _FACTS)


def call_edges(found: DataFrame) -> DataFrame:
    """Calls to functions and methods by simple name, in the same file first: file, caller, callee_file, callee."""
    symbols = found.where("fact = 'symbol' and kind <> 'Class'").select(F.col("file").alias("callee_file"), F.col("name").alias("callee"), F.element_at(F.split("name", r"\."), -1).alias("simple"))
    calls = found.where("fact = 'call' and holder is not null").select("file", F.col("holder").alias("caller"), F.col("name").alias("simple")).distinct()
    both = calls.join(symbols, "simple")
    local = both.where("file = callee_file")
    far = both.join(local.select("file", "caller", "simple").distinct(), ["file", "caller", "simple"], "left_anti")
    return local.unionByName(far).select("file", "caller", "callee_file", "callee").distinct()
