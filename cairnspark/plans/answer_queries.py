"""Queries of routed questions, context packets and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C
from ..operators import answers as A
from .catalog import query
from .model import blocks, hops, read, symbols
from .storage import table


def _named(spark, d):
    """Symbols whose names are identifiers."""
    return symbols(spark, d).select("id", F.concat(F.lit("part_"), F.col("id").cast("string")).alias("name"), "size")


def _calls(spark, d):
    return hops(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


@query(
    "v5_routed_questions",
    """WITH top AS (SELECT id FROM sym ORDER BY size DESC, id LIMIT 5)
      SELECT s_suppkey AS ask, 'callers' AS intent, src AS answer FROM supplier JOIN hop ON dst = s_suppkey WHERE s_suppkey % 4 = 0
      UNION ALL SELECT s_suppkey, 'callees', dst FROM supplier JOIN hop ON src = s_suppkey WHERE s_suppkey % 4 = 1
      UNION ALL SELECT s_suppkey, 'find', id FROM supplier JOIN sym ON id = s_suppkey WHERE s_suppkey % 4 = 2
      UNION ALL SELECT s_suppkey, 'complex', id FROM supplier, top WHERE s_suppkey % 4 = 3""",
)
def _(spark, d):
    name = F.concat(F.lit("part_"), F.col("s_suppkey").cast("string"))
    kind = F.col("s_suppkey") % 4
    question = (
        F.when(kind == 0, F.concat(F.lit("Who calls '"), name, F.lit("' in this project?")))
        .when(kind == 1, F.concat(F.lit("callees of "), name))
        .when(kind == 2, F.concat(F.lit('where is "'), F.upper(name), F.lit('"')))
        .otherwise("show the most complex functions")
    )
    questions = read(spark, d, "supplier").select(F.col("s_suppkey").alias("ask"), question.alias("question"))
    known, calls = _named(spark, d), _calls(spark, d)
    found = lambda asked: asked.join(known.select("name", "id"), "name")
    largest = known.orderBy(F.desc("size"), "id").limit(5).select(F.lit("complex").alias("intent"), F.col("id").alias("answer"))
    return A.routed(
        questions,
        {
            "find": lambda asked: found(asked).withColumnRenamed("id", "answer"),
            "callers": lambda asked: found(asked).join(calls, F.col("id") == F.col("dst")).withColumnRenamed("src", "answer"),
            "callees": lambda asked: found(asked).join(calls, F.col("id") == F.col("src")).withColumnRenamed("dst", "answer"),
            "complex": lambda asked: asked.join(F.broadcast(largest), "intent"),
        },
    )


_WAYS = """{0}1 AS (SELECT DISTINCT symbol, {1} AS id FROM seed JOIN hop ON {2} = symbol), {0}2 AS (SELECT DISTINCT symbol, h.{1} AS id FROM {0}1 JOIN hop h ON h.{2} = {0}1.id),
  {0} AS (SELECT task, symbol, id, depth FROM seed JOIN (SELECT symbol, id, min(depth) AS depth FROM (SELECT symbol, id, CAST(1 AS BIGINT) AS depth FROM {0}1 UNION ALL SELECT symbol, id, CAST(2 AS BIGINT) FROM {0}2) WHERE id <> symbol GROUP BY symbol, id) USING (symbol))"""


@query(
    "v6_packets",
    f"""WITH seed AS (SELECT task, symbol FROM (SELECT s_suppkey AS task, unnest([s_suppkey, s_suppkey + 1]) AS symbol FROM supplier) JOIN sym ON id = symbol),
      {_WAYS.format("up", "src", "dst")}, {_WAYS.format("down", "dst", "src")}
      SELECT task, symbol, 'find' AS section, symbol AS id, CAST(0 AS BIGINT) AS depth FROM seed
      UNION ALL SELECT task, symbol, 'caller', id, depth FROM up WHERE depth = 1 UNION ALL SELECT task, symbol, 'callee', id, depth FROM down WHERE depth = 1
      UNION ALL SELECT task, symbol, 'impact', id, depth FROM up UNION ALL SELECT task, symbol, 'affected', id, depth FROM down""",
)
def _(spark, d):
    key = F.col("s_suppkey")
    text = F.concat(F.lit("repair part_"), key.cast("string"), F.lit(" so that part_"), (key + 1).cast("string"), F.lit(" keeps its result"))
    tasks = read(spark, d, "supplier").select(key.alias("task"), text.alias("text"))
    return A.packets(tasks, _named(spark, d), _calls(spark, d))


@query(
    "t8_sweep",
    """WITH f AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS snapshot_id, CAST(user_id AS VARCHAR) AS path, md5(max(event_type)) AS hash FROM events GROUP BY 1, 2),
      s AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS place FROM (SELECT DISTINCT snapshot_id FROM f) WHERE snapshot_id % 3 <> 1)
      SELECT f.snapshot_id, f.path, f.hash, EXISTS (SELECT 1 FROM f o JOIN s p ON p.snapshot_id = o.snapshot_id WHERE p.place = s.place - 1 AND o.path = f.path AND o.hash = f.hash) AS copied
      FROM f JOIN s ON s.snapshot_id = f.snapshot_id""",
)
def _(spark, d):
    day = F.dayofyear("ts").cast("long").alias("snapshot_id")
    files = read(spark, d, "events").groupBy(day, F.col("user_id").cast("string").alias("path")).agg(F.md5(F.max("event_type")).alias("hash"))
    return A.swept(files, files.select("snapshot_id").where("snapshot_id % 3 <> 1"))


@query(
    "v5_all_routes",
    """WITH RECURSIVE q AS (SELECT s_suppkey AS ask, s_suppkey % 9 AS k FROM supplier), top AS (SELECT id FROM sym ORDER BY size DESC, id LIMIT 5),
      up AS (SELECT ask, ask AS id, 0 AS d FROM q WHERE k = 5 UNION SELECT ask, h.src, d + 1 FROM up JOIN hop h ON h.dst = id WHERE d < 2), down AS (SELECT ask, ask AS id, 0 AS d FROM q WHERE k = 6 UNION SELECT ask, h.dst, d + 1 FROM down JOIN hop h ON h.src = id WHERE d < 2),
      r AS (SELECT min(src) AS node FROM hop WHERE src IN (SELECT dst FROM hop)), f AS (SELECT node FROM r UNION SELECT h.dst FROM f JOIN hop h ON h.src = node), b AS (SELECT node FROM r UNION SELECT h.src FROM b JOIN hop h ON h.dst = node),
      t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM documents),
      w AS (SELECT doc_id, CAST(len(list_filter(t, lambda x: x = 'the')) AS DOUBLE) AS tf, len(t) AS l, (SELECT avg(len(t)) FROM t) AS m FROM t),
      s AS (SELECT doc_id FROM w WHERE tf > 0 ORDER BY round(-greatest(ln(((SELECT count(*) FROM w) - (SELECT count(*) FROM w WHERE tf > 0) + 0.5) / ((SELECT count(*) FROM w WHERE tf > 0) + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)), 6), doc_id LIMIT 5)
      SELECT ask, 'find' AS intent, ask AS answer FROM q JOIN sym ON id = ask WHERE k = 0 UNION ALL SELECT ask, 'callers', src FROM q JOIN hop ON dst = ask WHERE k = 1 UNION ALL SELECT ask, 'callees', dst FROM q JOIN hop ON src = ask WHERE k = 2
      UNION ALL SELECT ask, 'cfg', CAST(turn AS BIGINT) FROM q JOIN conversations ON conv_id = ask JOIN sym ON id = ask WHERE k = 3 UNION ALL SELECT ask, 'complex', id FROM q, top WHERE k = 4 UNION ALL SELECT DISTINCT ask, 'impact', id FROM up WHERE id <> ask
      UNION ALL SELECT DISTINCT ask, 'blast_zone', id FROM down WHERE id <> ask UNION ALL SELECT ask, 'cycles', (SELECT min(node) FROM f WHERE node IN (SELECT node FROM b)) FROM q WHERE k = 7 UNION ALL SELECT ask, 'search', doc_id FROM q, s WHERE k = 8""",
)
def _(spark, d):
    name, kind = F.concat(F.lit("part_"), F.col("s_suppkey").cast("string")), F.col("s_suppkey") % 9
    asked = {0: "where is '", 1: "Who calls '", 2: "callees of '", 3: "show CFG of '", 5: "what breaks with '", 6: "blast-zone of '"}
    question = F.when(kind == 4, "show the most complex functions").when(kind == 7, "which circular calls are there").when(kind == 8, "look for 'the'")
    for k, text in asked.items():
        question = question.when(kind == k, F.concat(F.lit(text), name, F.lit("'")))
    questions = read(spark, d, "supplier").select(F.col("s_suppkey").alias("ask"), question.alias("question"))
    texts = C.load(spark, C.build(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))
    calls = table(_calls(spark, d), "calls")  # five routes read them
    return A.routed(questions, A.standard(_named(spark, d), calls, blocks(spark, d), texts, depth=2))


@query(
    "s23_catalog",
    """WITH e AS (SELECT file_path AS project, kind, count(*) AS n FROM sym GROUP BY 1, 2), g AS (SELECT s.file_path AS project, s.kind, count(*) AS n FROM hop JOIN sym s ON s.id = src WHERE s.size % 2 = 0 GROUP BY 1, 2),
      c AS (SELECT DISTINCT file_path AS project FROM sym WHERE price > 1900), p AS (SELECT DISTINCT file_path AS project FROM sym UNION SELECT 'none'),
      es AS (SELECT project, sum(n) AS n, string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) AS k FROM e GROUP BY 1), gs AS (SELECT project, sum(n) AS n, string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) AS k FROM g GROUP BY 1)
      SELECT p.project, concat_ws(',', CASE WHEN c.project IS NOT NULL THEN 'code_chunks' END, CASE WHEN gs.n > 0 THEN 'graph_edges' END, CASE WHEN es.n > 0 THEN 'graph_entities' END) AS tables, CAST(coalesce(es.n, 0) AS BIGINT) AS entities, CAST(coalesce(gs.n, 0) AS BIGINT) AS edges,
      coalesce(es.k, '') AS entity_kinds, coalesce(gs.k, '') AS edge_kinds, concat_ws(',', CASE WHEN es.n > 0 AND gs.n > 0 THEN 'find,refs,calls,navigate,context' END, CASE WHEN c.project IS NOT NULL THEN 'chunks,slice' END) AS capabilities
      FROM p LEFT JOIN es USING (project) LEFT JOIN gs USING (project) LEFT JOIN c ON c.project = p.project""",
)
def _(spark, d):
    s = symbols(spark, d).withColumnRenamed("file_path", "project")
    edges = _calls(spark, d).join(s.where("size % 2 = 0").select(F.col("id").alias("src"), "project", "kind"), "src")
    registered = s.select("project").distinct().unionByName(spark.createDataFrame([("none",)], "project string"))
    found = A.catalogued(registered, {"graph_entities": s, "graph_edges": edges, "code_chunks": s.where("price > 1900")})
    listed = [F.array_join(c, ",").alias(c) for c in ("tables", "entity_kinds", "edge_kinds", "capabilities")]
    return found.select("project", "entities", "edges", *listed)
