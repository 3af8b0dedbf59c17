"""Queries of graph operators, metrics, ranks and versions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics as M, temporal as T, traversal as A
from .catalog import query
from .model import blocks, hops, read, sites, symbols, versions
from .storage import table


def _edges(spark, d):
    return hops(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def _node(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def _stored(spark, d):
    """The edges as a table, for queries that read them several times, and its least caller as one row."""
    e = table(_edges(spark, d), "calls")
    return e, _first(e)


def _first(edges):
    return edges.agg(F.min("src").alias("node"))


def _least(spark, d):
    return _first(_edges(spark, d))


_START = "start AS (SELECT min(src) AS node FROM hop)"
_FORWARD = f"WITH RECURSIVE {_START}, r AS (SELECT node FROM start UNION SELECT h.dst FROM r JOIN hop h ON h.src = r.node)"
_BACK = f"WITH RECURSIVE {_START}, r AS (SELECT node FROM start UNION SELECT h.src FROM r JOIN hop h ON h.dst = r.node)"


@query("a1_reachable", f"{_FORWARD} SELECT s.id, s.file_path, s.name FROM r JOIN sym s ON s.id = r.node WHERE r.node NOT IN (SELECT node FROM start)")
def _(spark, d):
    e, start = _stored(spark, d)
    found = A.reach(e, start, stored=True).where("depth > 0").select(F.col("node").alias("id"))
    return symbols(spark, d).join(found, "id").select("id", "file_path", "name")


@query("a2_reverse_reachable", f"{_BACK} SELECT s.id, s.file_path, s.name FROM r JOIN sym s ON s.id = r.node WHERE r.node NOT IN (SELECT node FROM start)")
def _(spark, d):
    e, start = _stored(spark, d)
    found = A.reach(A.flipped(e), start, stored=True).where("depth > 0").select(F.col("node").alias("id"))
    return symbols(spark, d).join(found, "id").select("id", "file_path", "name")


@query("a3_dead_code", f"{_FORWARD} SELECT s.id, s.file_path, s.name, 'unreachable from the entry' AS reason FROM (SELECT src AS node FROM hop UNION SELECT dst FROM hop) u JOIN sym s ON s.id = u.node WHERE u.node NOT IN (SELECT node FROM r)")
def dead_code(spark, d):
    e, start = _stored(spark, d)
    found = A.dead(e, start, stored=True).select(F.col("node").alias("id"))
    return symbols(spark, d).join(found, "id").select("id", "file_path", "name", F.lit("unreachable from the entry").alias("reason"))


@query(
    "a4_k_hop_callees",
    """WITH RECURSIVE r AS (SELECT CAST(5 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT h.dst, r.depth + 1 FROM r JOIN hop h ON h.src = r.node WHERE r.depth < 3)
      SELECT node, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0""",
)
def _(spark, d):
    return A.reach(_edges(spark, d), _node(spark, 5), 3).where("depth > 0")


@query(
    "a5_impact",
    """WITH RECURSIVE r AS (SELECT CAST(7 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT h.src, r.depth + 1 FROM r JOIN hop h ON h.dst = r.node WHERE r.depth < 4)
      SELECT s.name, s.file_path, min(depth) AS depth FROM r JOIN sym s ON s.id = r.node WHERE r.depth > 0 AND r.node <> 7 GROUP BY 1, 2""",
)
def _(spark, d):
    hit = A.reach(A.flipped(_edges(spark, d)), _node(spark, 7), 4).where("depth > 0")
    named = hit.join(symbols(spark, d), hit["node"] == F.col("id"))
    return named.groupBy("name", "file_path").agg(F.min("depth").alias("depth"))


@query(
    "a6_affected",
    """WITH RECURSIVE r AS (SELECT CAST(5 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT h.dst, r.depth + 1 FROM r JOIN hop h ON h.src = r.node WHERE r.depth < 4)
      SELECT s.name, s.file_path, min(depth) AS depth FROM r JOIN sym s ON s.id = r.node WHERE r.depth > 0 AND r.node <> 5 GROUP BY 1, 2""",
)
def _(spark, d):
    hit = A.reach(_edges(spark, d), _node(spark, 5), 4).where("depth > 0")
    named = hit.join(symbols(spark, d), hit["node"] == F.col("id"))
    return named.groupBy("name", "file_path").agg(F.min("depth").alias("depth"))


@query(
    "a7_blast_score",
    """WITH RECURSIVE r AS (SELECT CAST(7 AS BIGINT) AS node, 0 AS depth UNION SELECT h.src, r.depth + 1 FROM r JOIN hop h ON h.dst = r.node WHERE r.depth < 60),
      m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1), c AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(DISTINCT file_path) FILTER (depth > 0) AS files FROM m JOIN sym ON sym.id = m.node)
      SELECT direct, transitive, CAST(direct + transitive * 0.5 AS DOUBLE) AS score, CAST(round(100.0 * files / (SELECT count(DISTINCT file_path) FROM sym), 6) AS DOUBLE) AS risk,
      CASE WHEN direct + transitive * 0.5 >= 20 THEN 'HIGH' WHEN direct + transitive * 0.5 >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""",
)
def _(spark, d):
    files = symbols(spark, d).select(F.col("id").alias("node"), F.col("file_path").alias("file"))
    out = A.blast(_edges(spark, d), files, _node(spark, 7))
    return out.withColumns({"score": F.col("score").cast("double"), "risk": F.col("risk").cast("double")})


_SCC = """WITH RECURSIVE c AS (SELECT src, dst FROM hop UNION SELECT c.src, h.dst FROM c JOIN hop h ON h.src = c.dst),
  m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS scc FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1)"""


@query("a8_cycles", f"{_SCC} SELECT node, scc FROM m")
def _(spark, d):
    return A.cycles(_edges(spark, d))


@query(
    "a9_condensation",
    f"{_SCC}, n AS (SELECT u.node, coalesce(m.scc, u.node) AS scc FROM (SELECT src AS node FROM hop UNION SELECT dst FROM hop) u LEFT JOIN m ON m.node = u.node) "
    "SELECT DISTINCT a.scc AS src, b.scc AS dst FROM hop h JOIN n a ON a.node = h.src JOIN n b ON b.node = h.dst WHERE a.scc <> b.scc",
)
def _(spark, d):
    return A.condense(_edges(spark, d))[1]


@query("a10_slice_statistics", f"{_FORWARD}, b AS (SELECT node FROM start UNION SELECT h.src FROM b JOIN hop h ON h.dst = b.node) SELECT 'forward' AS direction, count(*) - 1 AS control_dependencies, CAST(0 AS BIGINT) AS data_dependencies FROM r UNION ALL SELECT 'backward', count(*) - 1, 0 FROM b")
def _(spark, d):
    e, start = _stored(spark, d)
    one = A.reach(e, start, stored=True).where("depth > 0").agg(F.lit("forward").alias("direction"), F.count("*").alias("control_dependencies"), F.lit(0).cast("long").alias("data_dependencies"))
    two = A.reach(A.flipped(e), start, stored=True).where("depth > 0").agg(F.lit("backward").alias("direction"), F.count("*").alias("control_dependencies"), F.lit(0).cast("long").alias("data_dependencies"))
    return one.unionByName(two)


@query(
    "a11_simple_paths",
    """WITH RECURSIVE s AS (SELECT min(src) AS node FROM hop), p AS (SELECT [node] AS path FROM s UNION ALL SELECT list_append(p.path, h.dst) FROM p JOIN hop h ON h.src = p.path[-1] WHERE NOT list_contains(p.path, h.dst) AND len(p.path) < 4)
      SELECT array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS length FROM p WHERE len(path) > 1 AND (len(path) = 4 OR path[-1] NOT IN (SELECT src FROM hop))""",
)
def _(spark, d):
    e = _edges(spark, d)
    found = A.simple_paths(e, _least(spark, d), 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").cast("long").alias("length"))


@query("a12_collisions", "SELECT value, n, ids FROM (SELECT name AS value, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM sym GROUP BY 1 HAVING count(*) > 1) ORDER BY n DESC, value LIMIT 25")
def _(spark, d):
    found = A.collisions(symbols(spark, d), "name").orderBy(F.desc("n"), "value").limit(25)
    return found.select("value", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "a13_decayed_search",
    """WITH seed AS (SELECT id AS node, 1.0::DOUBLE AS score FROM sym WHERE name = 'red widget'), l1 AS (SELECT h.dst AS node, max(score * 0.7) AS score FROM seed JOIN hop h ON h.src = seed.node GROUP BY 1),
      l2 AS (SELECT h.dst AS node, max(score * 0.7) AS score FROM l1 JOIN hop h ON h.src = l1.node GROUP BY 1) SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM seed UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1""",
)
def _(spark, d):
    seeds = symbols(spark, d).where("name = 'red widget'").select(F.col("id").alias("node"), F.lit(1.0).alias("score"))
    return A.decayed(_edges(spark, d), seeds, 2).select("node", F.round("score", 6).alias("score"))


@query(
    "a14_k_hop_references",
    """WITH RECURSIVE r AS (SELECT CAST(5 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT h.src, r.depth + 1 FROM r JOIN hop h ON h.dst = r.node WHERE r.depth < 2)
      SELECT node, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0""",
)
def _(spark, d):
    return A.reach(A.flipped(_edges(spark, d)), _node(spark, 5), 2).where("depth > 0")


@query(
    "a16_symbol_detail",
    """SELECT s.id, s.name, (SELECT count(*) FROM hop WHERE dst = s.id) AS callers, (SELECT count(*) FROM hop WHERE src = s.id) AS callees, (SELECT count(*) FROM sym o WHERE o.file_path = s.file_path) - 1 AS related FROM sym s""",
)
def _(spark, d):
    s, e = symbols(spark, d), M.fans(_edges(spark, d))
    near = s.groupBy("file_path").agg((F.count("*") - 1).alias("related"))
    few = s.join(e.withColumnRenamed("node", "id"), "id", "left").join(near, "file_path")
    return few.select("id", "name", F.coalesce("fan_in", F.lit(0)).cast("long").alias("callers"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("callees"), "related")


_DAILY = """e AS (SELECT * FROM (SELECT snapshot_id, stable_id AS src, lead(stable_id) OVER (PARTITION BY snapshot_id ORDER BY sec, event_id) AS dst, kind FROM ver) WHERE dst IS NOT NULL AND kind = 'error' AND src <> dst)"""


def _daily(spark, d):
    v = versions(spark, d)
    pairs = v.withColumn("dst", F.lead("stable_id").over(Window.partitionBy("snapshot_id").orderBy("at", "event_id")))
    return pairs.where("dst is not null and kind = 'error' and stable_id <> dst").select("snapshot_id", F.col("stable_id").alias("src"), "dst")


_DAILY_SCC = f"""WITH RECURSIVE {_DAILY}, c AS (SELECT snapshot_id, src, dst FROM e UNION SELECT c.snapshot_id, c.src, e.dst FROM c JOIN e ON e.snapshot_id = c.snapshot_id AND e.src = c.dst),
  m AS (SELECT a.snapshot_id, a.src AS node, least(a.src, min(a.dst)) AS scc FROM c a JOIN c b ON a.snapshot_id = b.snapshot_id AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1, 2)"""


@query("a18_snapshot_cycles", f"{_DAILY_SCC} SELECT snapshot_id, node, scc FROM m")
def _(spark, d):
    return T.snapshot_cycles(_daily(spark, d))


@query("g1_kind_counts", "SELECT kind, count(*) AS n FROM sym GROUP BY 1")
def _(spark, d):
    return M.kind_counts(symbols(spark, d))


@query("g4_staleness", "SELECT stable_id, max(sec) AS newest, (SELECT max(sec) FROM ver) - max(sec) > 86400 AS stale FROM ver GROUP BY 1")
def _(spark, d):
    v = versions(spark, d)
    newest = v.agg(F.max("at").alias("top"))
    return v.groupBy("stable_id").agg(F.max("at").alias("newest")).crossJoin(F.broadcast(newest)).select("stable_id", "newest", (F.col("top") - F.col("newest") > 86400).alias("stale"))


@query("g5_version_aggregates", "SELECT stable_id, max(snapshot_id) AS newest, count(DISTINCT snapshot_id) AS snapshots, count(*) AS n FROM ver GROUP BY 1")
def _(spark, d):
    return versions(spark, d).groupBy("stable_id").agg(F.max("snapshot_id").alias("newest"), F.countDistinct("snapshot_id").alias("snapshots"), F.count("*").alias("n"))


@query("g6_churn_top", "SELECT stable_id, count(*) AS n FROM ver GROUP BY 1 ORDER BY n DESC, stable_id LIMIT 20")
def _(spark, d):
    return T.churn_top(versions(spark, d), 20)


@query("g7_contributors", "SELECT o_custkey AS author, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, author LIMIT 10")
def _(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(10)


_FILES = """fm AS (SELECT b.file_path, b.symbol_count, b.loc, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, round(0.1 * b.loc + 0.5 * coalesce(i.n, 0) + 0.3 * coalesce(o.n, 0), 6) AS complexity FROM
  (SELECT file_path, count(*) AS symbol_count, CAST(sum(size) AS BIGINT) AS loc FROM sym GROUP BY 1) b
  LEFT JOIN (SELECT t.file_path, count(*) AS n FROM hop h JOIN sym f ON f.id = h.src JOIN sym t ON t.id = h.dst WHERE f.file_path <> t.file_path GROUP BY 1) i ON i.file_path = b.file_path
  LEFT JOIN (SELECT f.file_path, count(*) AS n FROM hop h JOIN sym f ON f.id = h.src JOIN sym t ON t.id = h.dst WHERE f.file_path <> t.file_path GROUP BY 1) o ON o.file_path = b.file_path)"""


@query("g8_file_metrics", f"WITH {_FILES} SELECT file_path, symbol_count, loc, fan_in, fan_out, CAST(complexity AS DOUBLE) AS complexity FROM fm")
def _(spark, d):
    return M.file_metrics(symbols(spark, d), _edges(spark, d))


@query("o2_hotspots", f"WITH {_FILES} SELECT file_path, CAST(complexity AS DOUBLE) AS complexity FROM fm WHERE loc >= 100 AND fan_in >= 5 ORDER BY complexity DESC, file_path LIMIT 20")
def _(spark, d):
    return M.hotspots(M.file_metrics(symbols(spark, d), _edges(spark, d)), 20, 100, 5).select("file_path", "complexity")


_SYMBOL = """sm AS (SELECT s.id, greatest(s.size, 1) AS loc, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(b.n, 0) + 1 AS cyclomatic FROM sym s LEFT JOIN (SELECT dst, count(*) AS n FROM hop GROUP BY 1) i ON i.dst = s.id
  LEFT JOIN (SELECT src, count(*) AS n FROM hop GROUP BY 1) o ON o.src = s.id LEFT JOIN (SELECT function_id, count(*) AS n FROM blk WHERE kind <> 'assistant' GROUP BY 1) b ON b.function_id = s.id)"""


def _symbol_metrics(spark, d):
    ends = blocks(spark, d).withColumn("terminator", F.when(F.col("kind") == "assistant", "Fallthrough").otherwise("return"))
    out = M.symbol_metrics(symbols(spark, d).select("id", "size"), _edges(spark, d), ends)
    return out.select("id", "loc", F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"), "cyclomatic")


@query("g9_symbol_metrics", f"WITH {_SYMBOL} SELECT id, loc, fan_in, fan_out, cyclomatic FROM sm")
def _(spark, d):
    return _symbol_metrics(spark, d)


_FEATURES = _SYMBOL + """, ft AS (SELECT sm.id, CAST(loc AS DOUBLE) AS loc, CAST(fan_in AS DOUBLE) AS fan_in, CAST(fan_out AS DOUBLE) AS fan_out, CAST(cyclomatic AS DOUBLE) AS complexity, CAST(coalesce(f.n, 0) AS DOUBLE) AS blocks, CAST(greatest(coalesce(f.n, 0) - 1, 0) AS DOUBLE) AS edges,
  CASE WHEN f.n > 0 THEN CAST(f.c AS DOUBLE) / f.n ELSE 0 END AS density, CAST(coalesce(v.days, 0) AS DOUBLE) AS lifetime, CAST(coalesce(v.n, 0) AS DOUBLE) AS churn FROM sm LEFT JOIN (SELECT function_id, count(*) AS n, count(*) FILTER (kind = 'user') AS c FROM blk GROUP BY 1) f ON f.function_id = sm.id
  LEFT JOIN (SELECT stable_id, count(DISTINCT snapshot_id) AS days, count(*) AS n FROM ver GROUP BY 1) v ON v.stable_id = sm.id)"""
_M2 = "round(" + " + ".join(f"{name} * CAST({weight} AS DOUBLE)" for name, weight in M.WEIGHTS.items()) + ", 6)"


def _features(spark, d):
    raw = blocks(spark, d)
    flow = raw.select("function_id", F.when(F.col("kind") == "user", "if").otherwise("body").alias("kind"))
    following = F.lead("block").over(Window.partitionBy("function_id").orderBy("block"))
    edges = raw.select("function_id", following.alias("target")).where("target is not null")
    return M.features(_symbol_metrics(spark, d), flow, edges, versions(spark, d))


@query("m1_features", f"WITH {_FEATURES} SELECT id, loc, fan_in, fan_out, complexity, blocks, edges, round(density, 9) AS density, lifetime, churn FROM ft")
def _(spark, d):
    return _features(spark, d).select("id", *(F.col(c).cast("double").alias(c) for c in M.WEIGHTS if c != "density"), F.round("density", 9).alias("density"))


@query("m2_linear_score", f"WITH {_FEATURES} SELECT id, {_M2} AS score FROM ft")
def _(spark, d):
    return _features(spark, d).select("id", F.round(M.linear_score(), 6).alias("score"))


@query("w1_rank", f"WITH {_FEATURES} SELECT id, {_M2} AS score, row_number() OVER (ORDER BY {_M2} DESC, id) AS rank FROM ft")
def _(spark, d):
    return M.ranked(_features(spark, d).select("id", F.round(M.linear_score(), 6).alias("score")), "score", "id")


@query("o1_top_candidates", f"WITH {_FEATURES} SELECT id, {_M2} AS score FROM ft ORDER BY score DESC, id LIMIT 30")
def _(spark, d):
    return _features(spark, d).select("id", F.round(M.linear_score(), 6).alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query("o3_cross_project_hotspots", f"WITH {_SYMBOL} SELECT s.kind AS project, sm.id, fan_in * cyclomatic AS heat FROM sm JOIN sym s ON s.id = sm.id ORDER BY heat DESC, sm.id LIMIT 25")
def _(spark, d):
    heat = _symbol_metrics(spark, d).join(symbols(spark, d).select("id", F.col("kind").alias("project")), "id")
    return heat.select("project", "id", (F.col("fan_in") * F.col("cyclomatic")).alias("heat")).orderBy(F.desc("heat"), "id").limit(25)


@query("g11_project_summary", "SELECT count(*) AS symbols, count(DISTINCT file_path) AS files, count(*) FILTER (kind = 'PROMO') AS promo, arg_max(kind, (n, kind)) AS primary_kind FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS n FROM sym)")
def _(spark, d):
    s = symbols(spark, d)
    one = s.agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("kind") == "PROMO").alias("promo"))
    top = M.kind_counts(s).agg(F.max_by("kind", F.struct("n", "kind")).alias("primary_kind"))
    return one.crossJoin(F.broadcast(top))


@query("g12_file_context", "SELECT file_path, count(*) AS n, count(DISTINCT kind) AS kinds, string_agg(name, ',' ORDER BY name) FILTER (price > 1050) AS public_names FROM (SELECT DISTINCT file_path, kind, name, price, id FROM sym) GROUP BY 1")
def _(spark, d):
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("price") > 1050, F.col("name")))), ",")
    out = symbols(spark, d).groupBy("file_path").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), names.alias("public_names"))
    return out.withColumn("public_names", F.nullif("public_names", F.lit("")))


@query("g13_coverage_totals", "SELECT quality, count(*) AS labelled, count(d.doc_id) AS found, CAST(coalesce(sum(d.n_chars), 0) AS BIGINT) AS chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", F.lit(1).alias("one"))
    both = read(spark, d, "labels").join(docs, "doc_id", "left")
    return both.groupBy("quality").agg(F.count("*").alias("labelled"), F.count("one").alias("found"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("g17_duplicate_files", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return read(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("g19_files_with_counts", "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left").groupBy("id").agg(F.count("o_orderkey").alias("n"))


@query("g20_display_groups", "SELECT name, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM sym GROUP BY 1")
def _(spark, d):
    ids = F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))
    return symbols(spark, d).groupBy("name").agg(F.array_join(ids, ",").alias("ids"))


@query("g21_dead_code_of_entries", """WITH RECURSIVE r AS (SELECT DISTINCT src AS node FROM hop WHERE src % 100 = 0 UNION SELECT h.dst FROM r JOIN hop h ON h.src = r.node) SELECT node FROM (SELECT src AS node FROM hop UNION SELECT dst FROM hop) WHERE node NOT IN (SELECT node FROM r)""")
def _(spark, d):
    e = _edges(spark, d)
    return A.dead(e, e.where("src % 100 = 0").select(F.col("src").alias("node")).distinct())


@query(
    "w2_segments",
    """WITH p AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS place FROM (SELECT DISTINCT snapshot_id FROM ver)), r AS (SELECT DISTINCT v.stable_id, v.kind, p.snapshot_id, p.place FROM ver v JOIN p ON p.snapshot_id = v.snapshot_id),
      m AS (SELECT *, CASE WHEN lag(place) OVER (PARTITION BY stable_id, kind ORDER BY place) + 1 = place THEN 0 ELSE 1 END AS starts FROM r)
      SELECT stable_id, kind, min(snapshot_id) AS born, max(snapshot_id) AS last_seen, count(*) AS lifetime, CAST(sum(starts) - 1 AS BIGINT) AS churn FROM m GROUP BY 1, 2""",
)
def _(spark, d):
    v = versions(spark, d)
    return T.lineages(v, ["stable_id", "kind"], v)


@query("w3_first_and_last", "SELECT stable_id, arg_min(kind, (sec, event_id)) AS first_kind, arg_max(kind, (sec, event_id)) AS last_kind FROM ver GROUP BY 1")
def _(spark, d):
    order = F.struct("at", "event_id")
    return versions(spark, d).groupBy("stable_id").agg(F.min_by("kind", order).alias("first_kind"), F.max_by("kind", order).alias("last_kind"))


@query("w5_every_fifth", "SELECT stable_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stable_id ORDER BY sec, event_id) AS n FROM ver) WHERE (n - 1) % 5 = 0")
def _(spark, d):
    return T.every_nth(versions(spark, d), "stable_id", ["at", "event_id"], 5).select("stable_id", "event_id")


@query("w6_greedy_batches")
def _(spark, d):
    files = read(spark, d, "documents").select((F.col("doc_id") % 16).alias("project"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"))
    return M.greedy_batches(files, 20_000)


@query("o4_page", "SELECT id, name, position, total, pages, next FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS position, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS pages, CASE WHEN ceil(count(*) OVER () / 50.0) > 3 THEN to_base64(encode('page=4')) END AS next FROM sym) WHERE position BETWEEN 101 AND 150")
def _(spark, d):
    from ..operators.lookup import cursor_page

    return cursor_page(symbols(spark, d).select("id", "name"), [F.col("name"), F.col("id")], 3, 50)


@query("o7_match_relevance", "SELECT id, CASE WHEN name = 'red ring' THEN 100 WHEN starts_with(name, 'red') THEN 75 WHEN contains(name, 'red') THEN 50 ELSE 0 END AS score FROM sym WHERE contains(name, 'red')")
def _(spark, d):
    name = F.col("name")
    score = F.when(name == "red ring", 100).when(name.startswith("red"), 75).when(name.contains("red"), 50).otherwise(0)
    return symbols(spark, d).where(name.contains("red")).select("id", score.alias("score"))


@query("t1_as_of", "SELECT event_id, stable_id, kind FROM ver WHERE snapshot_id = 12")
def _(spark, d):
    return T.as_of(versions(spark, d), 12).select("event_id", "stable_id", "kind")


@query("t2_symbol_barcodes", "SELECT stable_id, count(*) AS n_versions, count(DISTINCT snapshot_id) AS n_snapshots, min(snapshot_id) AS first_seen, max(snapshot_id) AS last_seen FROM ver GROUP BY 1")
def _(spark, d):
    return T.barcodes(versions(spark, d), ["stable_id"])


@query("t3_edge_barcodes", f"WITH {_DAILY} SELECT src, dst, count(*) AS n_versions, count(DISTINCT snapshot_id) AS n_snapshots, min(snapshot_id) AS first_seen, max(snapshot_id) AS last_seen FROM e GROUP BY 1, 2")
def _(spark, d):
    return T.barcodes(_daily(spark, d), ["src", "dst"])


@query(
    "t4_component_barcodes",
    f"""{_DAILY_SCC}, k AS (SELECT snapshot_id, scc, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM m GROUP BY 1, 2), p AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS place FROM (SELECT DISTINCT snapshot_id FROM ver)),
      g AS (SELECT k.members, k.snapshot_id, p.place, CASE WHEN lag(p.place) OVER (PARTITION BY k.members ORDER BY p.place) + 1 = p.place THEN 0 ELSE 1 END AS starts FROM k JOIN p ON p.snapshot_id = k.snapshot_id)
      SELECT members, min(snapshot_id) AS born, max(snapshot_id) AS last_seen, count(*) AS lifetime, CAST(sum(starts) - 1 AS BIGINT) AS churn FROM g GROUP BY 1""",
)
def _(spark, d):
    found = T.snapshot_cycles(_daily(spark, d))
    members = F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), ",")
    keyed = found.groupBy("snapshot_id", "scc").agg(members.alias("members"))
    return T.lineages(keyed, ["members"], versions(spark, d))


@query("t5_status", "SELECT count(DISTINCT snapshot_id) AS snapshots, count(*) AS versions, count(DISTINCT stable_id) AS symbols, max(snapshot_id) AS newest, (SELECT count(*) FROM sites) AS edges FROM ver")
def _(spark, d):
    return T.status(versions(spark, d), sites(spark, d))


@query("t7_copied_or_changed", "SELECT c.k, CASE WHEN p.v = c.v THEN true ELSE false END AS copied FROM (SELECT doc_id AS k, md5(text) AS v FROM documents) c LEFT JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE md5(text) END AS v FROM documents WHERE doc_id % 5 <> 0) p ON p.k = c.k")
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.md5("text").alias("v"))
    old = docs.where("k % 5 <> 0").select("k", F.when(F.col("k") % 3 == 0, "x").otherwise(F.col("v")).alias("v"))
    return T.copied_or_changed(old, docs, "k", "v").select("k", "copied")
