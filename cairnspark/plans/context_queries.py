"""Queries of refresh sets, source text, call sites, budgets, explored symbols, catalogues and statuses."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import search as S, text as X
from ..operators import context as C, facts as K
from ..sources import python_code as P
from .catalog import ORACLES, query
from .model import hops, read, symbols


def _table(df, name):
    return df.select(F.col(name).cast("string").alias("path"))


@query(
    "j19_refresh",
    """WITH known AS (SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 5 <> 0), there AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path FROM lineitem WHERE l_orderkey % 7 <> 3),
      st AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'untracked' WHEN o_totalprice > 300000 THEN 'modified' WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN 'deleted' END AS state FROM orders),
      act AS (SELECT path, 'update' AS action FROM known WHERE path IN (SELECT path FROM st WHERE state = 'modified')
        UNION ALL SELECT path, 'delete' FROM known WHERE path IN (SELECT path FROM st WHERE state = 'deleted') OR path NOT IN (SELECT path FROM there)
        UNION ALL SELECT path, 'add' FROM st WHERE state = 'untracked' AND path NOT IN (SELECT path FROM known) AND path IN (SELECT path FROM there))
      SELECT path, action FROM act UNION ALL SELECT path, 'unchanged' FROM known WHERE path NOT IN (SELECT path FROM act)""",
)
def _(spark, d):
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    state = F.when(key % 5 == 0, "untracked").when(F.col("o_totalprice") > 300000, "modified").when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 3 == 0), "deleted")
    status = o.select(key.cast("string").alias("path"), state.alias("state"))
    present = _table(read(spark, d, "lineitem").where("l_orderkey % 7 <> 3"), "l_orderkey")
    return C.refresh(_table(o.where("o_orderkey % 5 <> 0"), "o_orderkey"), status, present, untracked=True)


_IN = "IN ('8', '9', 'A', 'B')"


@query(
    "p18_source_text",
    f"""WITH t AS (SELECT doc_id, hex(encode(text)) AS h, doc_id % 50 AS s, doc_id % 50 + 37 + doc_id % 5 AS e FROM documents),
      u AS (SELECT *, CASE WHEN substr(h, 2 * e + 1, 1) NOT {_IN} THEN e WHEN substr(h, 2 * e - 1, 1) NOT {_IN} THEN e - 1 WHEN substr(h, 2 * e - 3, 1) NOT {_IN} THEN e - 2 ELSE e - 3 END AS f FROM t)
      SELECT doc_id, CASE WHEN 2 * e <= length(h) AND substr(h, 2 * s + 1, 1) NOT {_IN} THEN decode(unhex(substr(h, 2 * s + 1, 2 * (f - s)))) END AS part FROM u""",
)
def _(spark, d):
    start = F.col("doc_id") % 50
    return read(spark, d, "documents").select("doc_id", C.source_text(F.col("text").cast("binary"), start, start + 37 + F.col("doc_id") % 5).alias("part"))


_FLOW = """n AS (SELECT function_id, CAST(row_number() OVER (PARTITION BY function_id ORDER BY block) - 1 AS BIGINT) AS block, kind AS role, start_line, end_line FROM blk),
  b AS (SELECT function_id, block, CASE WHEN block = 0 THEN 'entry' WHEN role = 'user' THEN 'call' ELSE 'body' END AS kind, CASE WHEN role = 'assistant' THEN 'return' ELSE 'goto' END AS terminator, start_line AS byte_start, end_line AS byte_end FROM n),
  c AS (SELECT DISTINCT function_id, CAST(l AS BIGINT) AS call, CAST(l AS BIGINT) AS at, CAST(l + l % 2 AS BIGINT) AS until, function_id + 1 + l AS callee FROM blk, (SELECT unnest([1, 2, 4, 7]) AS l)),
  w AS (SELECT * FROM (SELECT c.function_id, c.call, c.callee, b.block, row_number() OVER (PARTITION BY c.function_id, c.call ORDER BY CASE WHEN b.kind = 'call' THEN 0 ELSE 1 END, b.block) AS nth
    FROM c JOIN b ON b.function_id = c.function_id AND b.byte_start <= c.at AND c.at <= b.byte_end AND c.until <= b.byte_end) WHERE nth = 1)"""


def _flow(spark, d):
    from .model import blocks

    raw = blocks(spark, d)
    nth = (F.row_number().over(Window.partitionBy("function_id").orderBy("block")) - 1).cast("long")
    kind = F.when(nth == 0, "entry").when(F.col("kind") == "user", "call").otherwise("body")
    rows = raw.select(
        "function_id", nth.alias("block"), kind.alias("kind"), F.when(F.col("kind") == "assistant", "return").otherwise("goto").alias("terminator"),
        F.col("start_line").alias("byte_start"), F.col("end_line").alias("byte_end"),
    )
    at = F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 2, 4, 7)))).alias("call")
    calls = raw.select("function_id").distinct().select("function_id", at)
    calls = calls.select("function_id", "call", F.col("call").alias("at"), (F.col("call") + F.col("call") % 2).alias("until"), (F.col("function_id") + 1 + F.col("call")).alias("callee"))
    edges = rows.select("function_id", F.col("block").alias("source"), (F.col("block") + 1).alias("target"), F.when(F.col("block") % 3 == 1, "Jump").otherwise("Fallthrough").alias("edge_type"))
    return rows, calls, edges


@query("j7_call_blocks", f"WITH {_FLOW} SELECT function_id, call, block FROM w")
def _(spark, d):
    rows, calls, _ = _flow(spark, d)
    return C.call_blocks(calls, rows).select("function_id", "call", "block")


@query(
    "j22_stitched_calls",
    f"""WITH {_FLOW}, e AS (SELECT callee, min(block) AS entry FROM (SELECT function_id AS callee, block FROM b WHERE kind = 'entry') GROUP BY 1),
      r AS (SELECT function_id AS callee, string_agg(CAST(block AS VARCHAR), ',' ORDER BY block) AS returns FROM b WHERE kind = 'return' OR terminator = 'return' GROUP BY 1)
      SELECT w.function_id, w.call, w.callee, w.block, e.entry, CASE WHEN w.block % 3 <> 1 AND EXISTS (SELECT 1 FROM b WHERE b.function_id = w.function_id AND b.block = w.block + 1) THEN w.block + 1 END AS resume, coalesce(r.returns, '') AS returns
      FROM w JOIN e ON e.callee = w.callee LEFT JOIN r ON r.callee = w.callee""",
)
def _(spark, d):
    rows, calls, edges = _flow(spark, d)
    out = C.stitched_calls(calls, rows, edges)
    return out.withColumn("returns", F.array_join(F.transform("returns", lambda x: x.cast("string")), ","))


@query("o6_token_budget", "SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE substring(text, 1, 200) || chr(10) || chr(10) || '*[truncated to budget]*' || chr(10) END AS part FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", C.within_budget(F.col("text"), 50).alias("part"))


@query("o6_capped_lists", "SELECT file_path, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY id) AS n FROM sym) WHERE n <= 5 GROUP BY 1")
def _(spark, d):
    few = Window.partitionBy("file_path").orderBy("id")
    rows = symbols(spark, d).withColumn("n", F.row_number().over(few)).where(F.col("n") <= C.CAPS["concise"])
    return rows.groupBy("file_path").agg(F.array_join(F.transform(C.capped(F.sort_array(F.collect_list("id")), "concise"), lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "v2_status_updates",
    """SELECT id, CASE WHEN s = 'O' THEN 'accepted' WHEN s = 'F' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN s = 'F' THEN prio END AS reason, CASE WHEN s IN ('O', 'F') THEN moment END AS reviewed_at
      FROM (SELECT o_orderkey AS id, o_orderpriority AS prio, CAST(o_custkey AS BIGINT) AS moment, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS s FROM orders)""",
)
def _(spark, d):
    o = read(spark, d, "orders")
    facts = o.select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"))
    said = o.where("o_orderkey % 4 <> 0 and o_orderstatus in ('O', 'F')").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "accepted").otherwise("rejected").alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("reason"), F.col("o_custkey").alias("at")
    )
    # an older decision is overruled
    old = said.select("id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(-1).cast("long").alias("at"))
    return K.updated(facts, said.unionByName(old)).select("id", "status", "reason", "reviewed_at")


@query("g2_kinds_in_order", "SELECT kind, count(*) AS n FROM sym GROUP BY 1 ORDER BY n DESC, kind")
def _(spark, d):
    return symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query("g22_project_statistics", "SELECT kind AS project, count(DISTINCT file_path) AS files, count(*) AS symbols, max(size) AS largest FROM sym GROUP BY 1 ORDER BY project")
def _(spark, d):
    rows = symbols(spark, d).groupBy(F.col("kind").alias("project"))
    return rows.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"), F.max("size").alias("largest")).orderBy("project")


@query("p28_metadata", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("p32_documents_of_kind", "SELECT source AS path, doc_id, n_chars FROM documents WHERE lang = 'fr' ORDER BY source, doc_id")
def _(spark, d):
    return read(spark, d, "documents").where("lang = 'fr'").select(F.col("source").alias("path"), "doc_id", "n_chars").orderBy("path", "doc_id")


def _stable(spark, d):
    stable = X.symbol_id(F.lit("rust"), F.col("file_path"), F.col("kind"), F.col("name"), F.col("id").cast("string"))
    return symbols(spark, d).withColumn("stable_id", stable)


_STABLE = "substring(sha256('rust:' || file_path || ':' || kind || ':' || name || ':' || CAST(id AS VARCHAR)), 1, 16)"


@query("p5_by_stable_id", f"SELECT id, name FROM sym WHERE {_STABLE} IN (SELECT {_STABLE} FROM sym WHERE id % 37 = 5)")
def _(spark, d):
    s = _stable(spark, d)
    return s.join(s.where("id % 37 = 5").select("stable_id"), "stable_id", "left_semi").select("id", "name")


@query("p12_slice_target", "SELECT id, name FROM (SELECT id, name, CASE WHEN name = 'small' THEN 1 WHEN contains(name, 'small') THEN 2 END AS r FROM sym) WHERE r IS NOT NULL ORDER BY r, id LIMIT 1")
def _(spark, d):
    return C.slice_target(_stable(spark, d), "small").select("id", "name")


@query(
    "a17_explore",
    """SELECT DISTINCT 'caller' AS section, src AS id FROM hop WHERE dst = 17 UNION SELECT 'callee', dst FROM hop WHERE src = 17 UNION SELECT 'chain', b.dst FROM hop a JOIN hop b ON b.src = a.dst WHERE a.src = 17""",
)
def _(spark, d):
    return C.explored(hops(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), 17)


@query("j3_hits_with_chunks", f"SELECT h.id, d.source, d.lang, h.score FROM ({ORACLES['f2_bm25']}) h JOIN documents d ON d.doc_id = h.id")
def _(spark, d):
    docs = read(spark, d, "documents")
    hits = S.bm25(docs.select(F.col("doc_id").alias("id"), "text"), ["the", "with"])
    return hits.join(docs.select(F.col("doc_id").alias("id"), "source", "lang"), "id").select("id", "source", "lang", "score")


def _python_files(spark, d):
    """A small Python file for each part; one in three doesn't parse."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    function = F.concat(F.lit("def f"), k, F.lit("(x):\n    if x:\n        return f"), s, F.lit("(x)\n    return x\n"))
    method = F.concat(F.lit("class C"), k, F.lit(":\n    def f"), k, F.lit("(self):\n        y = f"), s, F.lit("(1)\n"))
    broken = F.concat(F.lit("def f"), k, F.lit("(:\n"))
    kind = F.col("p_size") % 3
    return read(spark, d, "part").select(k.alias("file"), F.when(kind == 0, function).when(kind == 1, method).otherwise(broken).alias("content"))


_PARSED = "t AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size % 3 <> 2)"


@query(
    "s5_references",
    f"""WITH {_PARSED} SELECT CAST(a.k AS VARCHAR) AS file, 'f' || a.s AS name, CAST(3 AS BIGINT) AS line, CAST(CASE WHEN a.s % 3 = 0 THEN 15 ELSE 12 END AS BIGINT) AS col,
      CAST(b.k AS VARCHAR) AS symbol_file, CASE WHEN b.s % 3 = 1 THEN 'C' || b.k || '.' ELSE '' END || 'f' || b.k AS symbol FROM t a JOIN t b ON a.s = b.k WHERE a.k <> b.k""",
)
def _(spark, d):
    files = _python_files(spark, d)
    return P.references(files, P.facts(files))


@query(
    "p19_tree_kinds",
    f"""WITH {_PARSED}, n AS (SELECT unnest(CASE WHEN s % 3 = 0 THEN ['FunctionDef', 'If', 'Return', 'Call', 'Return'] ELSE ['ClassDef', 'FunctionDef', 'Assign', 'Call'] END) AS kind,
      unnest(CASE WHEN s % 3 = 0 THEN [true, false, false, false, false] ELSE [true, false, false, false] END) AS is_root FROM t)
      SELECT kind, count(*) AS n, count(CASE WHEN is_root THEN 1 END) AS roots FROM n GROUP BY kind""",
)
def _(spark, d):
    return P.nodes(_python_files(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("parent").isNull(), 1)).alias("roots"))


@query(
    "p21_printed_tree",
    f"""WITH {_PARSED}, n AS (SELECT k, unnest(CASE WHEN s % 3 = 0 THEN ['FunctionDef f' || k || ' [1-4]', '  If [2-3]', '    Return [3-3]', '      Call [3-3]', '  Return [4-4]']
      ELSE ['ClassDef C' || k || ' [1-3]', '  FunctionDef f' || k || ' [2-3]', '    Assign [3-3]', '      Call [3-3]'] END) AS line,
      unnest(CASE WHEN s % 3 = 0 THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2, 3] END) AS node FROM t)
      SELECT CAST(k AS VARCHAR) AS file, CAST(node AS BIGINT) AS node, line FROM n""",
)
def _(spark, d):
    return P.printed(P.nodes(_python_files(spark, d)))
