"""Queries of lookups, joins and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import four_places
from ..operators import joins as J, lookup as L
from ..sources.files import skip_reason
from .catalog import query
from .model import blocks, read, sites, symbols, versions


@query("p1_symbols_in_file", "SELECT id, name, kind FROM sym WHERE file_path = 'Brand#7'")
def _(spark, d):
    s = symbols(spark, d)
    files = s.select(F.col("file_path").alias("path")).distinct().withColumn("id", F.xxhash64("path"))
    defines = s.select(F.xxhash64("file_path").alias("from_id"), F.col("id").alias("to_id"))
    return L.symbols_in_file(files, defines, s, "Brand#7").select("id", "name", "kind")


@query("p2_symbols_in_file_of_kind", "SELECT id, name FROM sym WHERE file_path = 'Brand#7' AND kind = 'PROMO'")
def _(spark, d):
    s = symbols(spark, d)
    files = s.select(F.col("file_path").alias("path")).distinct().withColumn("id", F.xxhash64("path"))
    defines = s.select(F.xxhash64("file_path").alias("from_id"), F.col("id").alias("to_id"))
    return L.symbols_in_file(files, defines, s, "Brand#7", "PROMO").select("id", "name")


@query("p3_symbol_extents", "SELECT file_path, name, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM sym GROUP BY 1, 2")
def _(spark, d):
    return symbols(spark, d).groupBy("file_path", "name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("p4_first_by_file_and_name", "SELECT file_path, name, min(id) AS id FROM sym GROUP BY 1, 2")
def _(spark, d):
    return L.first_by(symbols(spark, d), ["file_path", "name"], [F.col("id")]).select("file_path", "name", "id")


@query("p6_exact_name", "SELECT id, name, file_path FROM sym WHERE name = 'red widget'")
def _(spark, d):
    return L.by_name(symbols(spark, d), "red widget").select("id", "name", "file_path")


@query("p7_prefix", "SELECT id, name FROM sym WHERE starts_with(lower(name), 're')")
def _(spark, d):
    return L.by_prefix(symbols(spark, d), "RE").select("id", "name")


@query("p8_glob", "SELECT id, name FROM sym WHERE regexp_matches(name, '^s.*r.ng$')")
def _(spark, d):
    return L.by_glob(symbols(spark, d), "s*r?ng").select("id", "name")


@query(
    "p9_find_top10",
    """SELECT id, name, score FROM (SELECT id, name, CAST(CASE WHEN name = 'ring' THEN 100 WHEN contains(name, 'ring') THEN 10 ELSE 0 END
      + CASE WHEN price > 1000 THEN 50 ELSE 0 END + CASE WHEN NOT size < 5 THEN 30 ELSE 0 END + 20 + 2 AS BIGINT) AS score FROM sym WHERE contains(name, 'ring'))
      ORDER BY score DESC, id LIMIT 10""",
)
def _(spark, d):
    s = symbols(spark, d).where(F.col("name").contains("ring"))
    score = L.relevance(F.col("name"), "ring", F.col("file_path"), F.col("kind"), F.col("price") > 1000, F.col("size") < 5)
    return s.select("id", "name", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("p11_resolve", "SELECT id, name FROM sym WHERE name = 'small ring' OR CAST(id AS VARCHAR) = 'small ring' ORDER BY (CAST(id AS VARCHAR) <> 'small ring'), id LIMIT 1")
def _(spark, d):
    s = symbols(spark, d).withColumn("symbol_id", F.col("id").cast("string"))
    return L.resolve(s, "small ring", ("symbol_id", "name")).select("id", "name")


_LABELS = "lab AS (SELECT p_partkey AS entity_id, p_brand AS label FROM part UNION SELECT p_partkey, p_type FROM part UNION SELECT p_partkey, 'size' || CAST(p_size // 10 AS VARCHAR) FROM part)"


def _labels(spark, d):
    p = read(spark, d, "part")
    bucket = F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string"))
    return p.select(F.col("p_partkey").alias("entity_id"), F.explode(F.array("p_brand", "p_type", bucket)).alias("label")).distinct()


@query("p13_label", f"WITH {_LABELS} SELECT DISTINCT entity_id FROM lab WHERE label = 'PROMO'")
def _(spark, d):
    return L.with_label(_labels(spark, d), "PROMO")


@query("p14_labels_all_of", f"WITH {_LABELS} SELECT entity_id FROM lab WHERE label IN ('PROMO', 'size1') GROUP BY 1 HAVING count(DISTINCT label) = 2")
def _(spark, d):
    return L.with_all_labels(_labels(spark, d), ["PROMO", "size1"])


@query("g3_label_counts", f"WITH {_LABELS} SELECT label, count(DISTINCT entity_id) AS n FROM lab GROUP BY 1")
def _(spark, d):
    return _labels(spark, d).groupBy("label").agg(F.countDistinct("entity_id").alias("n"))


@query("p15_ambiguous", "SELECT id, kind FROM sym WHERE name = 'red widget' ORDER BY id")
def _(spark, d):
    return L.by_name(symbols(spark, d), "red widget").select("id", "kind").orderBy("id")


def _chunks(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.col("lang").alias("kind"), (F.col("doc_id") * 100000).alias("byte_start"), (F.col("doc_id") * 100000 + F.col("n_chars")).alias("byte_end"), "text")


@query("p16_chunks_of_kind", "SELECT doc_id AS id, source AS file_path FROM documents WHERE lang = 'de' ORDER BY source, doc_id LIMIT 50")
def _(spark, d):
    return L.chunks(_chunks(spark, d), kind="de", limit=50).select("id", "file_path")


@query("p17_dynamic_filters", "SELECT doc_id AS id, source AS file_path FROM documents WHERE contains(source, 'src1') AND lang = 'en' AND n_chars >= 5000")
def _(spark, d):
    return L.chunks(_chunks(spark, d), path_part="src1", kind="en", least=5000).select("id", "file_path")


@query(
    "p20_node_at_position",
    """SELECT file, pos, node FROM (SELECT b.function_id AS file, p.pos, b.block AS node, row_number() OVER (PARTITION BY b.function_id, p.pos ORDER BY b.end_line + 1 - b.start_line, b.block) AS n
      FROM blk b JOIN (SELECT DISTINCT function_id, CAST(3 AS BIGINT) AS pos FROM blk) p ON b.function_id = p.function_id AND b.start_line <= p.pos AND p.pos < b.end_line + 1) WHERE n = 1""",
)
def _(spark, d):
    b = blocks(spark, d)
    nodes = b.select(F.col("function_id").alias("file"), F.col("block").alias("node"), F.col("start_line").alias("byte_start"), (F.col("end_line") + 1).alias("byte_end"))
    positions = b.select(F.col("function_id").alias("file")).distinct().withColumn("pos", F.lit(3).cast("long"))
    return L.node_at(nodes, positions).select("file", "pos", "node")


@query("p22_entities_by_id", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_linenumber = 7)")
def _(spark, d):
    wanted = read(spark, d, "lineitem").where("l_quantity >= 50 and l_linenumber = 7").select(F.col("l_partkey").alias("id"))
    return symbols(spark, d).join(wanted, "id", "left_semi").select("id", "name")


@query("p23_references_to", "SELECT file, place, count(*) AS n FROM sites WHERE callee = 7 GROUP BY 1, 2")
def _(spark, d):
    return sites(spark, d).where("callee = 7").groupBy("file", "place").agg(F.count("*").alias("n"))


@query("p24_blocks_of_function", "SELECT function_id, block, kind, start_line, end_line FROM blk")
def _(spark, d):
    return blocks(spark, d).select("function_id", "block", "kind", "start_line", "end_line")


@query(
    "p25_live_blocks",
    """SELECT p_partkey AS id FROM part WHERE CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 5 = 1 THEN p_type IN ('PROMO', 'SMALL')
      WHEN p_size % 5 = 2 THEN p_type NOT IN ('PROMO', 'SMALL') WHEN p_size % 5 = 3 THEN p_type IN ('PROMO', 'SMALL') ELSE true END""",
)
def _(spark, d):
    p = read(spark, d, "part")
    named = lambda head: F.concat(F.lit(head + '(feature = "'), F.col("p_type"), F.lit('", feature = "PROMO")'))
    one = lambda head: F.concat(F.lit(head + '(feature = "'), F.col("p_type"), F.lit('")'))
    step = F.col("p_size") % 5
    condition = F.when(step == 0, None).when(step == 1, one("all")).when(step == 2, one("not")).when(step == 3, named("all")).otherwise(F.lit("target_os"))
    return p.where(L.is_live(condition, ["PROMO", "SMALL"])).select(F.col("p_partkey").alias("id"))


@query("x1_json_filter", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("p27_context_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS context, sha256(text) AS checksum FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", L.context_lines(F.col("text"), F.lit(2), 1).alias("context"), F.sha2("text", 256).alias("checksum"))


@query("p29_newest_events", "SELECT event_id, stable_id, kind FROM ver ORDER BY sec DESC, event_id DESC LIMIT 100")
def _(spark, d):
    return L.latest(versions(spark, d), ["at", "event_id"], 100).select("event_id", "stable_id", "kind")


@query(
    "p30_phase_durations",
    """SELECT e.event_id, e.stable_id AS run, e.sec - max(s.sec) AS duration FROM ver e JOIN ver s ON e.stable_id = s.stable_id AND s.kind = 'signup'
      AND (s.sec < e.sec OR s.sec = e.sec AND s.event_id < e.event_id) WHERE e.kind = 'purchase' GROUP BY e.event_id, e.stable_id, e.sec""",
)
def _(spark, d):
    v = versions(spark, d).select(F.col("stable_id").alias("run"), "kind", "at", F.col("event_id").alias("id"))
    return L.phase_durations(v, "signup", "purchase").select(F.col("id").alias("event_id"), "run", "duration")


@query("p31_events_since", "SELECT event_id, kind FROM ver WHERE kind = 'error' AND snapshot_id BETWEEN 10 AND 20 ORDER BY sec DESC, event_id DESC LIMIT 200")
def _(spark, d):
    return L.latest(versions(spark, d).where("kind = 'error' and snapshot_id between 10 and 20"), ["at", "event_id"], 200).select("event_id", "kind")


_URLPATH = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


@query(
    "p34_suffix_paths",
    f"""WITH paths AS (SELECT DISTINCT {_URLPATH} AS path FROM pages), tails AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1),
      lambda k: array_to_string(string_split(path, '/')[len(string_split(path, '/')) - k + 1:], '/'))) AS query FROM paths)
      SELECT query, min(path) AS path FROM tails WHERE query LIKE '%/%' AND query NOT LIKE '%.example%' GROUP BY 1 HAVING count(DISTINCT path) = 1""",
)
def _(spark, d):
    paths = read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")).distinct()
    depth = F.sequence(F.lit(1), F.size(F.split("path", "/")))
    tails = F.transform(depth, lambda k: F.array_join(F.slice(F.split("path", "/"), F.size(F.split("path", "/")) - k + 1, k), "/"))
    asked = paths.select(F.explode(tails).alias("query")).distinct().where("query like '%/%' and query not like '%.example%'")
    return L.suffix_matches(paths, asked)


@query("p35_normal_paths", "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/$', '') AS path, false AS climbs FROM pages")
def _(spark, d):
    raw = F.concat(F.lit("./a/../"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/."))
    return read(spark, d, "pages").select("page_id", L.normal_path(raw).alias("path"), L.climbs(raw).alias("climbs"))


_PATH = "'a/' || (CASE page_id % 6 WHEN 0 THEN 'target/' WHEN 1 THEN 'gen/' WHEN 2 THEN 'venv/' WHEN 3 THEN 'build/' ELSE '' END) || 'x' || page_id || (CASE page_id % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.txt' WHEN 2 THEN '.sqlite3' WHEN 3 THEN '.cjs' WHEN 4 THEN '.hip' WHEN 5 THEN '.RS' ELSE '.py' END)"


def _paths(spark, d):
    """Paths of several folders and languages, one for each page."""
    return read(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))


@query(
    "s2_skip_reason",
    f"""SELECT page_id, CASE WHEN regexp_matches(path, '/(target|venv)/') OR path LIKE '%.sqlite3' THEN 'internal' WHEN NOT regexp_matches(path, '[.](rs|cjs|hip|py)$') THEN 'unsupported' WHEN path LIKE '%/gen/%' THEN 'excluded' END AS reason
      FROM (SELECT page_id, {_PATH} AS path FROM pages)""",
)
def _(spark, d):
    return _paths(spark, d).select("page_id", skip_reason(F.col("path"), exclude=["*/gen/*"]).alias("reason"))


@query("s3_language", f"SELECT page_id, CASE regexp_extract(path, '[.]([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'cjs' THEN 'javascript' WHEN 'hip' THEN 'cpp' WHEN 'py' THEN 'python' END AS language FROM (SELECT page_id, {_PATH} AS path FROM pages)")
def _(spark, d):
    return _paths(spark, d).select("page_id", X.language_of(F.col("path")).alias("language"))


@query("s24_ordered_edges", "SELECT src, dst FROM hop ORDER BY src, dst")
def _(spark, d):
    from .model import hops

    return hops(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).orderBy("src", "dst")


@query("j1_versions_with_snapshots", "SELECT v.stable_id, v.kind, s.n AS snapshot_size FROM ver v JOIN (SELECT snapshot_id, count(*) AS n FROM ver GROUP BY 1) s ON v.snapshot_id = s.snapshot_id")
def _(spark, d):
    v = versions(spark, d)
    sizes = v.groupBy("snapshot_id").agg(F.count("*").alias("snapshot_size"))
    return v.join(sizes, "snapshot_id").select("stable_id", "kind", "snapshot_size")


_LINES = "pts AS (SELECT DISTINCT function_id, CAST(l AS BIGINT) AS line FROM blk, (SELECT unnest([1, 2, 4, 7, 11]) AS l))"


def _points(spark, d):
    return blocks(spark, d).select("function_id").distinct().select("function_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 2, 4, 7, 11)))).alias("line"))


@query(
    "j4_coverage_best_block",
    f"""WITH {_LINES} SELECT function_id, line, block FROM (SELECT p.function_id, p.line, b.block, row_number() OVER (PARTITION BY p.function_id, p.line
      ORDER BY CASE WHEN b.start_line = p.line THEN 0 ELSE 1 END, b.start_line DESC, b.block DESC) AS n FROM pts p JOIN blk b ON p.function_id = b.function_id AND p.line BETWEEN b.start_line AND b.end_line) WHERE n = 1""",
)
def _(spark, d):
    return J.best_range(_points(spark, d), blocks(spark, d), ["function_id"], "line", "start_line", "end_line", "block").select("function_id", "line", "block")


@query("j5_coverage_all_blocks", f"WITH {_LINES} SELECT p.function_id, p.line, b.block FROM pts p JOIN blk b ON p.function_id = b.function_id AND p.line BETWEEN b.start_line AND b.end_line")
def _(spark, d):
    return J.range_join(_points(spark, d), blocks(spark, d), ["function_id"], "line", "start_line", "end_line").select("function_id", "line", "block")


@query(
    "j6_innermost_span",
    """WITH holders AS (SELECT o_custkey AS k, o_orderkey AS holder, o_orderkey AS hs, o_orderkey + 2000 AS he FROM orders), spans AS (SELECT o_custkey AS k, o_orderkey AS ref, o_orderkey + 10 AS s, o_orderkey + 500 AS e FROM orders)
      SELECT ref, holder FROM (SELECT ref, holder, row_number() OVER (PARTITION BY s.k, ref ORDER BY he - hs, holder) AS n FROM spans s JOIN holders h ON s.k = h.k AND hs <= s AND e <= he) WHERE n = 1""",
)
def _(spark, d):
    o = read(spark, d, "orders")
    holders = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("holder"), F.col("o_orderkey").alias("hs"), (F.col("o_orderkey") + 2000).alias("he"))
    spans = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") + 10).alias("s"), (F.col("o_orderkey") + 500).alias("e"))
    return J.innermost(spans, holders, "k").select("ref", "holder")


def _reified(spark, d):
    s = sites(spark, d).groupBy("caller", "callee", "file").agg(F.count("*").alias("n"))
    call = F.xxhash64("caller", "callee", "file")
    return s.select(F.col("caller").alias("from_id"), call.alias("to_id"), F.lit("CALLER").alias("edge_type")).unionByName(s.select(call.alias("from_id"), F.col("callee").alias("to_id"), F.lit("CALLS").alias("edge_type")))


@query("j8_two_hop_calls", "SELECT caller, callee, count(*) AS n FROM (SELECT DISTINCT caller, callee, file FROM sites) GROUP BY 1, 2")
def _(spark, d):
    return J.call_pairs(_reified(spark, d)).groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("j9_callers_and_callees", "SELECT 'caller' AS side, caller AS other, file, place FROM sites WHERE callee = 11 UNION ALL SELECT 'callee', callee, file, place FROM sites WHERE caller = 11")
def _(spark, d):
    s = sites(spark, d)
    one = s.where("callee = 11").select(F.lit("caller").alias("side"), F.col("caller").alias("other"), "file", "place")
    return one.unionByName(s.where("caller = 11").select(F.lit("callee").alias("side"), F.col("callee").alias("other"), "file", "place"))


@query("j10_references", "SELECT callee AS target, count(*) AS n, count(DISTINCT file) AS files FROM sites GROUP BY 1")
def _(spark, d):
    return sites(spark, d).groupBy(F.col("callee").alias("target")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


_CALLS = "calls AS (SELECT o_orderkey AS call, 'Brand#' || CAST(o_custkey % 30 AS VARCHAR) AS file, p_name AS name FROM orders JOIN part ON p_partkey = o_orderkey % 200)"


def _calls(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 30).cast("string")).alias("file"), (F.col("o_orderkey") % 200).alias("k"))
    return o.join(read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k").drop("k")


def _named(spark, d):
    s = symbols(spark, d)
    return s.select("id", F.col("file_path").alias("file"), "name", F.concat_ws("::", "file_path", "name").alias("fqn"))


@query(
    "j11_resolve_calls",
    f"""WITH {_CALLS}, l AS (SELECT file_path AS file, name, min(id) AS id FROM sym GROUP BY 1, 2), f AS (SELECT file_path || '::' || name AS name, min(id) AS id FROM sym GROUP BY 1), a AS (SELECT name, min(id) AS id FROM sym GROUP BY 1)
      SELECT c.call, c.name, coalesce(l.id, f.id, a.id) AS target, CASE WHEN l.id IS NOT NULL THEN 'file' WHEN f.id IS NOT NULL THEN 'fqn' WHEN a.id IS NOT NULL THEN 'name' END AS how
      FROM calls c LEFT JOIN l ON c.file = l.file AND c.name = l.name LEFT JOIN f ON c.name = f.name LEFT JOIN a ON c.name = a.name""",
)
def _(spark, d):
    return J.resolve_names(_calls(spark, d), _named(spark, d)).select("call", "name", "target", "how")


@query(
    "j12_resolve_qualified",
    """WITH asked AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'crate::' || p_brand || '::' || p_name WHEN p_size % 3 = 1 THEN p_brand || '::' || p_name ELSE 'x::' || p_name END AS name, 'Brand#' || CAST(p_size % 25 AS VARCHAR) AS file FROM part),
      k AS (SELECT name, file, 0 AS r, name AS key FROM asked UNION ALL SELECT name, file, 1, regexp_replace(name, '^((crate|super|self)::)+', '') FROM asked UNION ALL SELECT name, file, 2, string_split(name, '::')[-1] FROM asked),
      s AS (SELECT id, file_path AS f, file_path || '::' || name AS key, true AS full_name FROM sym UNION ALL SELECT id, file_path, name, false FROM sym)
      SELECT name, file, id AS target FROM (SELECT k.name, k.file, s.id, row_number() OVER (PARTITION BY k.name, k.file ORDER BY k.r, CASE WHEN s.f = k.file THEN 0 ELSE 1 END, s.id) AS n FROM k JOIN s ON k.key = s.key WHERE s.full_name OR k.r = 2) WHERE n = 1""",
)
def _(spark, d):
    p = read(spark, d, "part")
    fqn = F.concat_ws("::", "p_brand", "p_name")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("crate::"), fqn)).when(F.col("p_size") % 3 == 1, fqn).otherwise(F.concat(F.lit("x::"), F.col("p_name")))
    asked = p.select(name.alias("name"), F.concat(F.lit("Brand#"), (F.col("p_size") % 25).cast("string")).alias("file")).distinct()
    return J.resolve_qualified(asked, _named(spark, d))


@query("j13_unique_only", "WITH n AS (SELECT p_partkey AS id, p_brand || ' ' || p_type || ' ' || p_name || ' ' || CAST(p_size AS VARCHAR) AS name FROM part), calls AS (SELECT o_orderkey AS call, n.name FROM orders JOIN n ON n.id = o_custkey), u AS (SELECT name, min(id) AS target FROM n GROUP BY 1 HAVING count(*) = 1) SELECT call, calls.name, target FROM calls JOIN u ON calls.name = u.name")
def _(spark, d):
    named = symbols(spark, d).select("id", F.concat_ws(" ", "file_path", "kind", "name", F.col("size").cast("string")).alias("name"))
    calls = read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("id")).join(named, "id").select("call", "name")
    return J.resolve_unique(calls, named).select("call", "name", "target")


@query("j14_parent_modules", "SELECT p_partkey AS id, p_brand || '::' || p_type AS parent, p_name AS simple FROM part")
def _(spark, d):
    full = F.concat_ws("::", "p_brand", "p_type", "p_name")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), X.parent_module(full).alias("parent"), X.simple_name(full).alias("simple"))


@query(
    "j15_orphans",
    """SELECT p_partkey AS id, 'no caller' AS problem FROM part WHERE p_partkey NOT IN (SELECT dst FROM hop) UNION ALL SELECT p_partkey, 'no callee' FROM part WHERE p_partkey NOT IN (SELECT src FROM hop)
      UNION ALL SELECT o_orderkey, 'no target' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def _(spark, d):
    edge = lambda start, to, kind: F.struct(start.cast("long").alias("from_id"), to.cast("long").alias("to_id"), F.lit(kind).alias("edge_type"))
    lines = read(spark, d, "lineitem").select(edge(F.col("l_orderkey"), F.lit(-1), "REFERENCES").alias("e"))
    # both edges of a call from one pass over the sites
    calls = sites(spark, d).select(F.explode(F.array(edge(F.lit(-1), F.col("callee"), "CALLER"), edge(F.col("caller"), F.lit(-1), "CALLS"))).alias("e"))
    refs, parts = read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), symbols(spark, d)
    return J.orphans(refs, parts, lines.unionByName(calls).select("e.*"))


_DIFF = """SELECT coalesce(e.k, c.k) AS k, e.v AS expected, c.v AS current, CASE WHEN c.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN e.v IS NOT DISTINCT FROM c.v THEN 'ok' ELSE 'changed' END AS status
  FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 7 <> 0) e FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS v FROM part WHERE p_partkey % 5 <> 0) c ON e.k = c.k"""


@query("j17_repair_status", _DIFF)
def _(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "k")
    one = p.where("k % 7 <> 0").select("k", F.col("p_name").alias("v"))
    two = p.where("k % 5 <> 0").select("k", F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.col("p_name")).alias("v"))
    return J.compared(one, two, ["k"], "v")


@query(
    "j18_verify_counts",
    "SELECT status, count(*) AS n FROM (" + _DIFF + ") GROUP BY 1",
)
def _(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "k")
    one = p.where("k % 7 <> 0").select("k", F.col("p_name").alias("v"))
    two = p.where("k % 5 <> 0").select("k", F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.col("p_name")).alias("v"))
    return J.compared(one, two, ["k"], "v").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "j20_structural_similarity",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label < b.label
      WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.2""",
)
def _(spark, d):
    e = read(spark, d, "embeddings")
    found = J.similar_in_blocks(e.select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vec")), 0.2)
    return found.select("a", "b", four_places(F.col("cosine")).alias("cosine"))


@query("j21_parent_snapshot", "SELECT c.child, max(s.snapshot_id) AS parent FROM (SELECT DISTINCT snapshot_id + 1 AS child FROM ver) c JOIN (SELECT DISTINCT snapshot_id FROM ver) s ON s.snapshot_id < c.child GROUP BY 1")
def _(spark, d):
    from ..operators.temporal import latest_parent

    v = versions(spark, d)
    return latest_parent(v, v.select((F.col("snapshot_id") + 1).alias("child")).distinct())


@query("j23_chain", "SELECT DISTINCT b.dst AS node FROM hop a JOIN hop c ON a.dst = c.dst JOIN hop b ON c.src = b.src WHERE a.src = 5")
def _(spark, d):
    from .model import hops

    e = hops(spark, d).select(F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), F.lit("CALLS").alias("edge_type"))
    return J.chain(e, spark.range(5, 6).select(F.col("id").alias("node")), [(">", "CALLS"), ("<", "CALLS"), (">", "CALLS")])


@query("j24_expand", "SELECT 'out' AS direction, dst AS other FROM hop WHERE src = 9 UNION ALL SELECT 'in', src FROM hop WHERE dst = 9")
def _(spark, d):
    from .model import hops

    e = hops(spark, d).select(F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), F.lit("CALLS").alias("edge_type"))
    return J.neighbours(e, 9).select("direction", "other")


@query("j25_pattern", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM hop a JOIN hop b ON a.dst = b.src JOIN sym x ON x.id = a.src AND x.kind = 'PROMO' JOIN sym y ON y.id = a.dst AND y.kind = 'SMALL' JOIN sym z ON z.id = b.dst AND z.kind = 'LARGE'")
def _(spark, d):
    from .model import hops

    e = hops(spark, d).select(F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), F.lit("CALLS").alias("edge_type"))
    return J.pattern(e, symbols(spark, d), [("PROMO", "CALLS", "SMALL"), ("SMALL", "CALLS", "LARGE")])


@query("k10_upsert", "SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size < 30 AND p_type <> 'PROMO' UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_type = 'PROMO'")
def _(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "k")
    return J.upsert(p.where("p_size < 30").select("k", F.col("p_name").alias("v")), p.where("p_type = 'PROMO'").select("k", F.upper("p_name").alias("v")), ["k"])


@query("u1_union_distinct", "SELECT src AS node FROM hop UNION SELECT dst FROM hop")
def _(spark, d):
    from .model import hops

    h = hops(spark, d)
    return h.select(F.col("caller").alias("node")).union(h.select("callee")).distinct()


@query("u2_across_projects", "SELECT name, string_agg(project, ',' ORDER BY project) AS projects FROM (SELECT DISTINCT p_name AS name, p_type AS project FROM part) GROUP BY 1")
def _(spark, d):
    s = symbols(spark, d).select("name", F.col("kind").alias("project")).dropDuplicates()
    return s.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("project")), ",").alias("projects"))


@query("u3_difference", "SELECT src AS node FROM hop EXCEPT SELECT dst FROM hop")
def _(spark, d):
    from .model import hops

    h = hops(spark, d)
    return h.select(F.col("caller").alias("node")).subtract(h.select("callee"))
