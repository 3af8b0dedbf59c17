"""Answers composed of other operators: routed questions, context packets for tasks, and the sweep over selected snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.content import ContentIndex, search
from ..plans.storage import table
from .traversal import cycles, flipped

Answer = Callable[[DataFrame], DataFrame]


def asked_name(question: Column) -> Column:
    """The symbol that a question names, in lower case: what stands in single quotes, else in double ones, else the last word; null
    without a word."""
    q = F.lower(question)
    quoted = [F.regexp_extract(q, f"^[^{c}]*{c}([^{c}]+){c}", 1) for c in "'\""]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (*quoted, F.regexp_extract(q, r"(\S+)\s*$", 1))))


def routed(questions: DataFrame, answers: Mapping[str, Answer]) -> DataFrame:
    """Questions (ask, question) answered by what their intent calls for: (ask, intent, answer).

    `answers` has for each intent a function from the questions of that intent (ask, intent, name) to rows (ask, answer). All questions of an
    intent are answered by one join; an intent without a function, and a question without an answer, give no row.
    """
    asked = questions.select("ask", X.intent(F.col("question")).alias("intent"), asked_name(F.col("question")).alias("name"))
    asked = table(asked, "questions")
    of = lambda name: answers[name](asked.where(F.col("intent") == name)).select("ask", F.lit(name).alias("intent"), "answer")
    return reduce(DataFrame.unionByName, (of(name) for name in sorted(answers)))


def reach_of_each(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(task, symbol, id, depth) for what each seed (task, symbol) reaches over edges (src, dst) in one to `most` hops, itself left out.

    Every hop is a table of new pairs, so the plan doesn't grow, and equal starts of several tasks are followed once.
    """
    starts = seeds.select("symbol").distinct()
    last = starts.select("symbol", F.col("symbol").alias("id"), F.lit(0).cast("long").alias("depth"))
    seen = last
    for depth in range(1, most + 1):
        step = last.select("symbol", F.col("id").alias("src")).join(edges, "src").select("symbol", F.col("dst").alias("id")).distinct()
        fresh = step.join(seen.select("symbol", "id"), ["symbol", "id"], "left_anti")
        last = table(fresh.withColumn("depth", F.lit(depth).cast("long")), "hop")
        seen = seen.unionByName(last)
    return seeds.select("task", "symbol").join(seen.where("depth > 0"), "symbol").select("task", "symbol", "id", "depth")


def packets(tasks: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 10, top: int = 3) -> DataFrame:
    """What one needs to know for tasks (task, text), from symbols (id, name) and calls (src, dst): (task, symbol, section, id, depth).

    The terms of a text name symbols (of each term the first `limit` by id, one for each name); of a task the first `top` are looked
    at. Sections: find (the symbol itself), caller and callee (one hop), impact and affected (callers and callees up to `depth` hops).
    """
    terms = tasks.select("task", F.posexplode(X.terms(F.col("text"))).alias("place", "name"))
    by_term = Window.partitionBy("task", "place").orderBy("id")
    hits = terms.join(symbols.select("id", "name"), "name").withColumn("nth", F.row_number().over(by_term)).where(F.col("nth") <= limit)
    named = hits.groupBy("task", "name").agg(F.min(F.struct("place", "id")).alias("first"))
    by_task = Window.partitionBy("task").orderBy("first")
    chosen = named.withColumn("nth", F.row_number().over(by_task)).where(F.col("nth") <= top)
    seeds = table(chosen.select("task", F.col("first.id").alias("symbol")), "packet-symbols")
    up, down = reach_of_each(flipped(edges), seeds, max(depth, 1)), reach_of_each(edges, seeds, max(depth, 1))
    shown = lambda rows, section: rows.select("task", "symbol", F.lit(section).alias("section"), "id", "depth")
    own = seeds.select("task", "symbol", F.col("symbol").alias("id"), F.lit(0).cast("long").alias("depth"))
    near = [shown(up.where("depth = 1"), "caller"), shown(down.where("depth = 1"), "callee")]
    return reduce(DataFrame.unionByName, [shown(own, "find"), *near, shown(up, "impact"), shown(down, "affected")])


def swept(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The files (snapshot_id, path, hash) of the selected snapshots (snapshot_id), with `copied`: whether the selected snapshot just
    before has the same path with the same hash, so that its facts are taken over and the file isn't read again.

    All snapshots are done in one join. The positions are one row per snapshot.
    """
    place = snapshots.select("snapshot_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("snapshot_id")))
    rows = files.join(F.broadcast(place), "snapshot_id")
    before = rows.select((F.col("place") + 1).alias("place"), "path", F.col("hash").alias("old")).distinct()
    same = before.withColumnRenamed("old", "hash").withColumn("copied", F.lit(True))
    return rows.join(same, ["place", "path", "hash"], "left").select("snapshot_id", "path", "hash", F.coalesce("copied", F.lit(False)).alias("copied"))


def standard(symbols: DataFrame, calls: DataFrame, blocks: DataFrame, texts: ContentIndex, depth: int = 3, most: int = 5) -> dict[str, Answer]:
    """Functions for all intents of routed(): symbols (id, name, size), calls (src, dst), blocks (function_id, block), a content index.

    find: the symbols of the name; callers and callees: one call away; cfg: the blocks of the function; blast_zone: what it reaches
    over up to `depth` calls; impact: what reaches it; cycles: the least member of each cycle; complex: the `most` largest
    symbols; search: the `most` best documents that hold the words of the name.
    """
    found = lambda asked: asked.join(symbols.select("name", "id"), "name")

    def spread(asked: DataFrame, edges: DataFrame) -> DataFrame:
        seeds = table(found(asked).select(F.col("ask").alias("task"), F.col("id").alias("symbol")), "asked")
        return reach_of_each(edges, seeds, depth).select(F.col("task").alias("ask"), F.col("id").alias("answer"))

    def whole(asked: DataFrame, intent: str, rows: DataFrame) -> DataFrame:
        return asked.join(rows.select(F.lit(intent).alias("intent"), F.col("id").alias("answer")), "intent")

    largest = symbols.orderBy(F.desc("size"), "id").limit(most)
    return {
        "find": lambda asked: found(asked).withColumnRenamed("id", "answer"),
        "callers": lambda asked: found(asked).join(calls, F.col("id") == F.col("dst")).withColumnRenamed("src", "answer"),
        "callees": lambda asked: found(asked).join(calls, F.col("id") == F.col("src")).withColumnRenamed("dst", "answer"),
        "cfg": lambda asked: found(asked).join(blocks.select(F.col("function_id").alias("id"), F.col("block").alias("answer")), "id"),
        "blast_zone": lambda asked: spread(asked, calls),
        "impact": lambda asked: spread(asked, flipped(calls)),
        "cycles": lambda asked: whole(asked, "cycles", cycles(calls).select(F.col("scc").alias("id")).distinct()),
        "complex": lambda asked: whole(asked, "complex", largest),
        "search": lambda asked: search(texts, asked.select(F.col("ask").alias("qid"), F.col("name").alias("query")), most).select(F.col("qid").alias("ask"), F.col("id").alias("answer")),
    }


#: What can be asked of a project, by the tables that it has all of (fixed values).
CAPABILITIES = (
    (("graph_entities", "graph_edges"), ("find", "refs", "calls", "navigate", "context")), (("cfg_blocks", "cfg_edges"), ("cfg", "paths", "dead-code", "cycles", "reachable")),
    (("code_chunks",), ("chunks", "slice")), (("symbol_fts",), ("search",)), (("cross_file_refs",), ("cross-file-refs",)), (("graph_labels",), ("label",)),
)


def catalogued(projects: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(project, tables, entities, edges, entity_kinds, edge_kinds, capabilities) of registered projects (project), whose rows stand in
    `tables` by name, each with project; graph_entities and graph_edges also with kind. Kinds are spelled kind=count, the most
    frequent first, ties by kind; a project without rows has empty lists."""
    kinds: dict[str, DataFrame] = {}
    present = []
    for name, rows in sorted(tables.items()):
        present.append(rows.groupBy("project").agg(F.lit(name).alias("table")))
        if name in ("graph_entities", "graph_edges"):
            counts = rows.groupBy("project", "kind").agg(F.count("*").alias("n"))
            listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))
            spelled = F.transform(listed, lambda x: F.concat(F.coalesce(x["kind"], F.lit("")), F.lit("="), (-x["n"]).cast("string")))
            kinds[name] = counts.groupBy("project").agg(F.sum("n").alias(f"{name}_n"), spelled.alias(f"{name}_kinds"))
    held = reduce(DataFrame.unionByName, present).groupBy("project").agg(F.sort_array(F.collect_list("table")).alias("tables"))
    none = F.array().cast("array<string>")
    out = projects.select("project").distinct().join(held, "project", "left").withColumn("tables", F.coalesce("tables", none))
    for name, label, one in (("graph_entities", "entities", "entity"), ("graph_edges", "edges", "edge")):
        rows = kinds.get(name, projects.select("project", F.lit(0).cast("long").alias(f"{name}_n"), none.alias(f"{name}_kinds")).limit(0))
        out = out.join(rows, "project", "left").withColumn(label, F.coalesce(f"{name}_n", F.lit(0))).withColumn(f"{one}_kinds", F.coalesce(f"{name}_kinds", none))
    able = F.concat(*(F.when(F.forall(F.array(*(F.lit(t) for t in needs)), lambda t: F.array_contains("tables", t)), F.array(*(F.lit(c) for c in can))).otherwise(none) for needs, can in CAPABILITIES))
    return out.select("project", "tables", "entities", "edges", "entity_kinds", "edge_kinds", able.alias("capabilities"))
