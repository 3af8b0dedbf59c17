"""Operators composed of others: refresh sets, source text by byte range, call sites in control flow, budgets, explored symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .joins import range_join
from .lookup import first_by

#: Fixed caps of lists by depth of an answer.
CAPS = {"concise": 5, "normal": 15, "deep": 50}
TRUNCATED = "\n\n*[truncated to budget]*\n"


def refresh(stored: DataFrame, status: DataFrame, present: DataFrame, untracked: bool = False, force: bool = False) -> DataFrame:
    """(path, action) that brings an index up to date: stored (path) is what it holds, status (path, state: modified, deleted or
    untracked) what changed, present (path) what exists. Actions: update, delete, add (only with `untracked`), unchanged."""
    known, there = stored.select("path").distinct(), present.select("path").distinct()
    of = lambda state: status.where(F.col("state") == state).select("path").distinct()
    if force:
        return known.withColumn("action", F.lit("update"))
    update = known.join(of("modified"), "path", "left_semi")
    delete = known.join(of("deleted"), "path", "left_semi").union(known.join(there, "path", "left_anti")).distinct()
    new = of("untracked").join(known, "path", "left_anti")
    add = new.join(there.union(of("modified")).distinct(), "path", "left_semi") if untracked else new.limit(0)
    named = lambda rows, action: rows.select("path", F.lit(action).alias("action"))
    affected = named(update, "update").unionByName(named(delete, "delete")).unionByName(named(add, "add"))
    return affected.unionByName(named(known.join(affected.select("path"), "path", "left_anti"), "unchanged"))


def _inside(content: Column, at: Column) -> Column:
    """Whether a byte offset splits a character of UTF-8."""
    return F.hex(F.substring(content, at + 1, F.lit(1))).rlike("^[89AB]")


def source_text(content: Column, start: Column, end: Column) -> Column:
    """Text of the bytes from start (from 0) to before end of a UTF-8 file. An end inside a character moves back to its start; null
    if the bounds are wrong, the start is inside a character or the file is no UTF-8."""
    start, end = start.cast("int"), end.cast("int")
    cut = F.when(~_inside(content, end), end)
    for back in (1, 2):
        cut = cut.when(~_inside(content, end - back), end - back)
    fits = (start >= 0) & (start <= end) & (end <= F.length(content)) & F.is_valid_utf8(content.cast("string")) & ~_inside(content, start)
    return F.when(fits, F.decode(F.substring(content, start + 1, F.greatest(cut.otherwise(end - 3) - start, F.lit(0))), "UTF-8"))


def call_blocks(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """Calls (function_id, call, at, until) with the block of their function that holds them: a block of kind call first, then the
    first one. blocks (function_id, block, kind, byte_start, byte_end)."""
    inside = range_join(calls, blocks, ["function_id"], "at", "byte_start", "byte_end").where("until <= byte_end")
    return first_by(inside, ["function_id", "call"], [F.when(F.col("kind") == "call", 0).otherwise(1), F.col("block")])


def stitched_calls(calls: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct calls (function_id, call, at, until, callee) stitched to the callee's flow: block, entry, resume (the least fallthrough
    target of the block, or null) and returns (the callee's return blocks in order). blocks also have a terminator; edges are
    (function_id, source, target, edge_type). Calls outside all blocks and callees without an entry are left out."""
    at = call_blocks(calls, blocks).select("function_id", "call", "callee", "block")
    entry = blocks.where("kind = 'entry'").groupBy(F.col("function_id").alias("callee")).agg(F.min("block").alias("entry"))
    out = blocks.where("kind = 'return' or terminator = 'return'").groupBy(F.col("function_id").alias("callee")).agg(F.sort_array(F.collect_set("block")).alias("returns"))
    targets = blocks.select("function_id", F.col("block").alias("target"))
    down = edges.where("lower(edge_type) = 'fallthrough' and target <> source").join(targets, ["function_id", "target"], "left_semi")
    resume = down.groupBy("function_id", F.col("source").alias("block")).agg(F.min("target").alias("resume"))
    found = at.join(entry, "callee").join(resume, ["function_id", "block"], "left").join(out, "callee", "left")
    return found.select("function_id", "call", "callee", "block", "entry", "resume", F.coalesce("returns", F.array().cast("array<long>")).alias("returns"))


def within_budget(text: Column, tokens: int) -> Column:
    """A text of at most 4 bytes a token as it is; of a longer one as many characters, and a note."""
    most = 4 * tokens
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(TRUNCATED)))


def capped(items: Column, depth: str = "normal") -> Column:
    """The first items of a list, as many as the depth of the answer allows."""
    return F.slice(items, 1, CAPS[depth])


def slice_target(symbols: DataFrame, key: str) -> DataFrame:
    """The symbol that a key names: by stable id, then by equal name, then by a name that contains it; the least id of several."""
    rank = F.when(F.col("stable_id") == key, 0).when(F.col("name") == key, 1).when(F.col("name").contains(key), 2)
    return symbols.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


def explored(edges: DataFrame, node: int) -> DataFrame:
    """(section, id): callers and callees of a node of edges (src, dst), and what its callees call."""
    callees = edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()
    callers = edges.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct()
    further = edges.join(callees.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
    named = lambda rows, section: rows.select(F.lit(section).alias("section"), "id")
    return named(callers, "caller").unionByName(named(callees, "callee")).unionByName(named(further, "chain"))


def halvings(first: int, least: int = 2) -> list[int]:
    """The lengths that a list is cut to until its answer fits: half of the last one, and none once it was `least` or fewer."""
    found = [first]
    while found[-1] > 0:
        found.append(found[-1] // 2 if found[-1] > least else 0)
    return found


#: What a cut answer ends with (fixed values).
PARTIAL = "\n... [Output truncated due to token budget]\n"
CUT = "\n... [Output truncated due to --token-budget]"


def _first_that_fits(states: Column, render: Callable[[Column], Column], tokens: Column) -> Column:
    """The first state whose answer has at most four bytes a token; the last one's answer cut to that, less 60 characters, if none."""
    answers = F.transform(states, render)
    fitting = F.get(F.filter(answers, lambda a: F.octet_length(a) <= 4 * tokens), F.lit(0))
    cut = F.concat(F.substring(F.element_at(answers, -1), F.lit(1), F.greatest(4 * tokens - 60, F.lit(0))), F.lit(CUT))
    return F.coalesce(fitting, cut)


def fitted_summary(head: Column, items: Column, tail: Column, tokens: Column, most: int = CAPS["normal"]) -> Column:
    """head, the items a line each, and tail: an answer of at most four bytes a token. The list is capped, then halved until the
    answer fits, then left out; what is cut says so at its end, and an answer that fits nevertheless not is cut as text."""
    title = lambda some: F.when(F.size(some) > 0, F.concat(F.lit("Entry Points:\n"), F.array_join(F.transform(some, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""), F.lit("\n"))).otherwise("")

    def render(n: Column) -> Column:
        some = F.slice(items, F.lit(1), n)
        return F.concat(head, title(some), tail, F.when((F.size(items) > most) | (n < most), PARTIAL).otherwise(""))

    return _first_that_fits(F.array(*(F.lit(n) for n in halvings(most))), render, tokens)


def fitted_symbol(head: Column, source: Column, callers: Column, callees: Column, tokens: Column, most: int = CAPS["normal"], lines: int = 40) -> Column:
    """head, source, callers and callees of a symbol as an answer of at most four bytes a token: the source's lines are halved first
    (left out from five down), then both lists together (from two down), then the text is cut."""
    states = [(s, most) for s in halvings(lines, 5)] + [(0, c) for c in halvings(most)[1:]]
    listed = lambda name, some: F.when(F.size(some) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(some, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))).otherwise("")
    text = F.split(source, "\n")

    def render(state: Column) -> Column:
        some = F.slice(text, F.lit(1), state["lines"])
        body = F.when(F.size(some) > 0, F.concat(F.lit("Source:\n"), F.array_join(some, "\n"), F.lit("\n"))).otherwise("")
        cut = (F.size(text) > lines) | (F.size(callers) > most) | (F.size(callees) > most) | (state["lines"] < lines)
        cap = F.least(state["list"], F.lit(most))
        return F.concat(head, body, listed("Callers", F.slice(callers, F.lit(1), cap)), listed("Callees", F.slice(callees, F.lit(1), cap)), F.when(cut, PARTIAL).otherwise(""))

    array = F.array(*(F.struct(F.lit(s).alias("lines"), F.lit(c).alias("list")) for s, c in states))
    return _first_that_fits(array, render, tokens)
