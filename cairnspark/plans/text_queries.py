"""Queries of text functions, search, coverage, facts, exports and stream replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search as S, text as X
from ..operators import exports as E, facts as K
from ..sources.files import selected_commits
from ..streaming import watch as W
from .catalog import query
from .model import hops, read, symbols, versions

_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query("x1_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_STOP = "('" + "','".join(X.STOP_WORDS) + "')"


@query(
    "x2_terms",
    f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), 1) AS i FROM conversations),
      f AS (SELECT conv_id, turn, arg_min(w, i) AS w, min(i) AS i FROM w WHERE (len(w) >= 3 OR contains(w, '_')) AND lower(w) NOT IN {_STOP} GROUP BY conv_id, turn, lower(w)),
      n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM f) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY k) AS terms FROM n WHERE k <= 8 GROUP BY 1, 2""",
)
def _(spark, d):
    out = read(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.terms(F.col("text")), " ").alias("terms"))
    return out.where("terms <> ''")


@query("x3_frontmatter", "SELECT doc_id, lang AS language, source AS origin FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    docs = read(spark, d, "documents").where("lang is not null and source is not null")
    page = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: x\nsource: "), F.col("source"), F.lit("\n---\n# T\n"), F.col("text"))
    fm = X.frontmatter(page)
    return docs.select("doc_id", fm["lang"].alias("language"), fm["source"].alias("origin"))


@query("x4_titles", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def _(spark, d):
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = read(spark, d, "pages").where(raw != "").withColumn("md", F.concat(F.lit("intro\n# "), F.trim(raw), F.lit("\ntext")))
    return pages.select("page_id", X.title(F.col("md")).alias("title"))


@query(
    "x5_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"|\\[\\]]+)"', 1)) AS x, generate_subscripts(regexp_extract_all(html, 'href="/([^"|\\[\\]]+)"', 1), 1) AS i FROM pages), t AS (SELECT page_id, trim(x) AS x, min(i) AS i FROM l WHERE trim(x) <> '' GROUP BY 1, 2)
      SELECT page_id, string_agg(x, ' ' ORDER BY i) AS links FROM t GROUP BY 1""",
)
def _(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="/([^"|\\[\\]]+)"'), 1)
    wiki = F.array_join(F.transform(found, lambda x: F.concat(F.lit("[["), x, F.lit("|shown]]"))), " ")
    out = read(spark, d, "pages").select("page_id", wiki.alias("w")).select("page_id", F.array_join(X.wikilinks(F.col("w")), " ").alias("links"))
    return out.where("links <> ''")


@query(
    "x6_tags",
    """SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'top ' || source ELSE NULL END, CASE WHEN doc_id % 2 = 0 AND lang IN ('top', source) THEN NULL ELSE lang END, CASE WHEN doc_id % 3 = 0 THEN 'n' || (doc_id % 5) END) AS tags
      FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""",
)
def _(spark, d):
    docs = read(spark, d, "documents").where("lang is not null and source is not null")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntags: [top, "), F.col("source"), F.lit("]\n---\n"))).otherwise("")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" see #n"), (F.col("doc_id") % 5).cast("string"), F.lit("."))).otherwise("")
    text = F.concat(head, F.lit("#fff and (#"), F.col("lang"), F.lit("), #a1b2c3 #"), F.col("lang"), more)
    return docs.select("doc_id", F.array_join(X.tags(text), " ").alias("tags"))


@query("x7_content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))


@query("x8_simple_names", "SELECT p_partkey AS id, p_name AS simple FROM part")
def _(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), X.simple_name(F.concat_ws("::", "p_brand", "p_name")).alias("simple"))


_KIND = "CASE event_type WHEN 'click' THEN 'Function' WHEN 'view' THEN 'mod' WHEN 'signup' THEN 'TypeAlias' WHEN 'error' THEN 'Class' ELSE 'func' END"


@query("x9_kinds", f"SELECT kind, CASE kind WHEN 'Function' THEN 'fn' WHEN 'mod' THEN 'mod' WHEN 'TypeAlias' THEN 'type_alias' WHEN 'Class' THEN 'struct' END AS normal, count(*) AS n FROM (SELECT {_KIND} AS kind FROM events) GROUP BY 1, 2")
def _(spark, d):
    rows = read(spark, d, "events").select(F.expr(_KIND).alias("kind"))
    return rows.groupBy("kind", X.normalized_kind(F.col("kind")).alias("normal")).agg(F.count("*").alias("n"))


@query("x10_dot_text", """SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS label FROM documents""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", E.dot_text(F.col("text")).alias("label"))


@query("x11_slices", "SELECT doc_id, substring(text, 11, 40) AS part FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.substring("text", 11, 40).alias("part"))


_ASKED = "CASE turn % 8 WHEN 0 THEN 'Who calls ' WHEN 1 THEN 'callees of ' WHEN 2 THEN 'show CFG of ' WHEN 3 THEN 'blast-zone ' WHEN 4 THEN 'what breaks with ' WHEN 5 THEN 'most complex ' WHEN 6 THEN 'look for ' ELSE '' END || role || ' ' || text"


def _intent_sql():
    whens = " ".join("WHEN " + " OR ".join(f"contains(q, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in X.INTENTS.items())
    return f"SELECT conv_id, turn, CASE {whens} ELSE 'find' END AS intent FROM (SELECT conv_id, turn, lower({_ASKED}) AS q FROM conversations)"


@query("x12_intent", _intent_sql())
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.intent(F.expr(_ASKED)).alias("intent"))


@query("x14_project_names", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/:]+)$', 1) AS raw, trim(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/:]+)$', 1), '[^A-Za-z0-9_.-]+', '-', 'g'), '-') AS name FROM pages")
def _(spark, d):
    raw = F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/:]+)$", 1)
    return read(spark, d, "pages").select("page_id", raw.alias("raw"), X.project_name(F.col("url")).alias("name"))


@query("x15_token_estimates", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))


@query("id1_stable_ids", "SELECT p_partkey AS id, substring(sha256('rust:' || p_brand || ':' || p_type || ':' || p_name || ':' || CAST(p_partkey AS VARCHAR)), 1, 16) AS stable FROM part")
def _(spark, d):
    stable = X.symbol_id(F.lit("rust"), F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_partkey").cast("string"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), stable.alias("stable"))


@query("f4_line_of_offset", "SELECT doc_id, CAST(length(substring(text, 1, length(text) * 2 // 3)) - length(replace(substring(text, 1, length(text) * 2 // 3), chr(10), '')) + 1 AS BIGINT) AS line FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.line_of(F.col("text"), F.expr("cast(length(text) * 2 div 3 as int)")).cast("long").alias("line"))


@query(
    "f1_prefix_search",
    f"""WITH t AS (SELECT id, name FROM sym WHERE len(list_filter({_TOK.format("name")}, lambda t: starts_with(t, 're'))) > 0 ORDER BY length(name), id LIMIT 40)
      SELECT id, name, CAST(round(1 - 0.5 * (row_number() OVER (ORDER BY length(name), id) - 1) / count(*) OVER (), 6) AS DOUBLE) AS score FROM t""",
)
def _(spark, d):
    return S.prefix_hits(symbols(spark, d), "re", 20)


@query(
    "f2_bm25",
    f"""WITH t AS (SELECT doc_id AS id, {_TOK.format("text")} AS t FROM documents), r AS (SELECT id, CAST(len(t) AS DOUBLE) AS l, CAST(len(list_filter(t, lambda x: x = 'the')) AS DOUBLE) AS a, CAST(len(list_filter(t, lambda x: x = 'with')) AS DOUBLE) AS b FROM t),
      s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS m, CAST(count(*) FILTER (a > 0) AS DOUBLE) AS da, CAST(count(*) FILTER (b > 0) AS DOUBLE) AS db FROM r)
      SELECT id, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM r, s WHERE a > 0 AND b > 0""",
)
def _(spark, d):
    return S.bm25(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "with"])


@query("f5_hashed_embedding")
def _(spark, d):
    return S.hashed_embedding(read(spark, d, "documents"), "doc_id", "text")


@query("f7_embed_text", "SELECT p_partkey AS id, p_type || chr(10) || p_name || chr(10) || p_brand || chr(10) || repeat('x', least(p_size * 100, 1024)) AS text FROM part")
def _(spark, d):
    body = F.repeat(F.lit("x"), F.col("p_size") * 100)
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.embed_text(F.col("p_type"), F.col("p_name"), F.col("p_brand"), body).alias("text"))


@query(
    "f8_nearest",
    """SELECT qid, id, similarity, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
)
def _(spark, d):
    e = read(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return S.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), queries, 10)


@query("f9_structure_hash", "SELECT conv_id, sha256(string_agg(role, '|' ORDER BY turn)) AS structure, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    nodes = read(spark, d, "conversations").select("conv_id", F.col("role").alias("kind"), F.col("turn").alias("byte_start"))
    return S.structure_hash(nodes, ["conv_id"])


@query("f10_best_per_project", """SELECT label AS project, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS best FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE vec_id <> 0 GROUP BY 1""")
def _(spark, d):
    e = read(spark, d, "embeddings")
    from ..operators.joins import cosine

    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    both = e.where("vec_id <> 0").crossJoin(F.broadcast(one))
    return both.groupBy(F.col("label").alias("project")).agg(F.round(F.max(cosine(F.col("embedding"), F.col("q"))), 6).alias("best"))


_FACTS = """facts AS (SELECT o_orderkey AS id, 'customer' AS subject_type, CAST(o_custkey AS VARCHAR) AS subject_key, CASE WHEN o_orderkey % 11 = 0 THEN 'eats' ELSE 'prefers' END AS predicate, CASE WHEN o_orderkey % 7 = 0 THEN 'color' ELSE 'priority' END AS object_type,
  o_orderpriority AS object_key, o_totalprice / 400000 AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'x' END AS note FROM orders)"""


def _facts(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("id"), F.lit("customer").alias("subject_type"), F.col("o_custkey").cast("string").alias("subject_key"), F.when(k % 11 == 0, "eats").otherwise("prefers").alias("predicate"),
        F.when(k % 7 == 0, "color").otherwise("priority").alias("object_type"), F.col("o_orderpriority").alias("object_key"), (F.col("o_totalprice") / 400000).alias("confidence"),
        F.create_map(F.lit("note"), F.when(k % 5 == 0, "").otherwise("x")).alias("properties"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )


_TYPES, _RELATIONS = [*K.ENTITY_TYPES, "Alien"], [*K.RELATIONS, "eats"]
_listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_CLAIMS = f"""claims AS (SELECT o_orderkey AS id, {_listed(_TYPES)}[o_orderkey % 13 + 1] AS subject_type, {_listed(_RELATIONS)}[o_custkey % 14 + 1] AS predicate, {_listed(_TYPES)}[o_orderkey // 13 % 13 + 1] AS object_type,
  o_totalprice / 400000 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'm' ELSE '' END AS mechanism FROM orders), pairs AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in K.ontology())}) p(s, p, o))"""


@query(
    "v1_ontology",
    f"""WITH {_CLAIMS} SELECT id, CASE WHEN predicate = 'eats' THEN 'unknown relation' WHEN predicate <> 'relates_to' AND NOT EXISTS (SELECT 1 FROM pairs WHERE s = subject_type AND p = predicate AND o = object_type) THEN 'types not allowed'
      WHEN predicate = 'caused_by' AND mechanism = '' THEN 'property missing' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence out of range' END AS reason FROM claims""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    of = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    claims = read(spark, d, "orders").select(
        k.alias("id"), of(_TYPES, k % 13).alias("subject_type"), of(_RELATIONS, F.col("o_custkey") % 14).alias("predicate"), of(_TYPES, F.floor(k / 13) % 13).alias("object_type"),
        (F.col("o_totalprice") / 400000).alias("confidence"), F.create_map(F.lit("mechanism"), F.when(k % 2 == 0, "m").otherwise(""), F.lit("evidence"), F.lit("e")).alias("properties"),
    )
    allowed = spark.createDataFrame(K.ontology(), "subject_type string, predicate string, object_type string")
    return K.validated(claims, allowed, K.NEEDS).select("id", "reason")


@query("g15_conflicts", f"WITH {_FACTS} SELECT subject_key, predicate, count(*) AS n, count(DISTINCT object_key) AS n_objects, string_agg(DISTINCT object_key, ',' ORDER BY object_key) AS objects FROM facts GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT object_key) > 1")
def _(spark, d):
    return K.conflicts(_facts(spark, d)).select("subject_key", "predicate", "n", "n_objects", F.array_join("objects", ",").alias("objects"))


@query("g16_duplicate_facts", f"WITH {_FACTS} SELECT a.id FROM facts a WHERE a.id % 2 = 0 AND EXISTS (SELECT 1 FROM facts b WHERE b.id % 2 = 1 AND b.subject_key = a.subject_key AND b.predicate = a.predicate AND b.object_key IS NOT DISTINCT FROM a.object_key)")
def _(spark, d):
    f = _facts(spark, d)
    return K.duplicates_of(f.where("id % 2 = 1").withColumn("status", F.lit("accepted")), f.where("id % 2 = 0")).select("id")


@query("p33_review_queue", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY epoch(o_orderdate) DESC, o_orderkey DESC LIMIT 100")
def _(spark, d):
    f = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("accepted").alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    return K.review_queue(f, 100).select("id")


@query("v3_stale_documents", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    old = docs.withColumn("hash", F.when(F.col("doc_id") % 4 == 1, F.lit("old")).otherwise(F.col("hash")))
    return K.stale(old, docs, "doc_id").select("doc_id")


@query("z6_reconcile", "SELECT event_id, CASE WHEN n > 1 AND kind = before THEN 'unchanged' ELSE 'index' END AS action FROM (SELECT event_id, kind, lag(kind) OVER w AS before, row_number() OVER w AS n FROM ver WINDOW w AS (PARTITION BY stable_id ORDER BY sec, event_id))")
def _(spark, d):
    return K.reconciled(versions(spark, d), "stable_id", ["at", "event_id"], "kind").select("event_id", "action")


@query(
    "z2_debounced_sessions",
    """WITH f AS (SELECT stable_id AS key, sec, event_id, CASE WHEN lag(sec) OVER w IS NULL OR sec - lag(sec) OVER w >= 7200 THEN 1 ELSE 0 END AS fresh FROM ver WINDOW w AS (PARTITION BY stable_id ORDER BY sec, event_id)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY sec, event_id) AS session FROM f) SELECT key, min(sec) AS start, max(sec) AS last, count(*) AS n FROM s GROUP BY key, session""",
)
def _(spark, d):
    v = versions(spark, d).select(F.col("stable_id").alias("key"), "at", F.col("event_id").alias("id"))
    return W.debounced_replay(v, 7200).select("key", "start", "last", "n")


@query("z4_mutations", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def _(spark, d):
    v = versions(spark, d).withColumn("kind", F.when(F.col("kind") == "click", "Modify").when(F.col("kind") == "view", "create").otherwise("access"))
    return W.mutations(v).select("event_id")


@query("z11_tumbling_windows", "SELECT epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    return W.windowed(e, "6 hours", None, "1 day").select(F.unix_seconds("start").cast("double").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@query("s17_commit_selection", "SELECT event_id AS oid FROM (SELECT event_id, row_number() OVER (ORDER BY sec, CAST(event_id AS VARCHAR)) AS n FROM ver WHERE kind = 'error' AND sec >= 1704500000) WHERE (n - 1) % 3 = 0")
def _(spark, d):
    v = versions(spark, d).where("kind = 'error'").select(F.col("event_id").cast("string").alias("oid"), F.col("at").alias("time"), F.lit(2).alias("n_parents"))
    return selected_commits(v, since=1704500000, merges_only=True, every=3).select(F.col("oid").cast("long").alias("oid"))


@query(
    "s15_lcov",
    "SELECT 'f' || CAST(p_size AS VARCHAR) || '.rs' AS source, p_partkey AS line, CAST(p_partkey % 9 AS BIGINT) AS hits FROM part",
)
def _(spark, d):
    from ..sources.formats import lcov, numbered_lines

    p = read(spark, d, "part")
    da = F.array_join(F.sort_array(F.collect_list(F.format_string("DA:%d,%d", F.col("p_partkey"), F.col("p_partkey") % 9))), "\n")
    files = p.groupBy("p_size").agg(da.alias("da")).select(
        F.col("p_size").cast("string").alias("file"), F.concat(F.lit("TN:\nSF:f"), F.col("p_size").cast("string"), F.lit(".rs\n"), F.col("da"), F.lit("\nend_of_record\n")).alias("content")
    )
    return lcov(numbered_lines(files))[0]


@query("k3_wide_records", "SELECT record_type, count(*) AS n, count(name) AS names, count(caller) AS callers FROM (SELECT 'symbol' AS record_type, id, name, NULL AS caller FROM sym UNION ALL SELECT 'call', NULL, NULL, src FROM hop) GROUP BY 1")
def _(spark, d):
    wide = E.records(symbol=symbols(spark, d).select("id", "name"), call=hops(spark, d).select("caller"))
    return wide.groupBy("record_type").agg(F.count("*").alias("n"), F.count("name").alias("names"), F.count("caller").alias("callers"))


@query("k2_json_lines")
def _(spark, d):
    return E.json_lines("2.0.0", symbol=symbols(spark, d).select("id", "name"), call=hops(spark, d))


@query("k1_file_json")
def _(spark, d):
    return E.graph_json(symbols=symbols(spark, d).select("file_path", "id", "name"))


@query(
    "k4_dot",
    """SELECT section, line FROM (SELECT 0 AS section, 'digraph {' AS line UNION ALL SELECT 3, '}' UNION ALL SELECT 1, '  "' || n || '";' FROM (SELECT CAST(src AS VARCHAR) AS n FROM hop UNION SELECT CAST(dst AS VARCHAR) FROM hop) UNION ALL SELECT 2, '  "' || CAST(src AS VARCHAR) || '" -> "' || CAST(dst AS VARCHAR) || '";' FROM hop)""",
)
def _(spark, d):
    h = hops(spark, d)
    return E.dot_lines(h.select(F.col("caller").cast("string").alias("caller"), F.col("callee").cast("string").alias("callee")))


@query("k5_scip_table", "SELECT file_path AS document, count(*) AS n, max(ordinal) AS last FROM (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY id) AS ordinal FROM sym) GROUP BY 1")
def _(spark, d):
    return E.scip(symbols(spark, d), "demo", "1.0").groupBy("document").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"))


@query("k6_lsif_counts", "SELECT 'package' AS label, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'document', count(DISTINCT file_path) FROM sym UNION ALL SELECT 'symbol', count(*) FROM sym UNION ALL SELECT 'contains', count(*) FROM sym")
def _(spark, d):
    return E.lsif(symbols(spark, d), "demo").groupBy("label").agg(F.count("*").alias("n"))


@query("k11_delete_file", "SELECT (SELECT count(*) FROM sym WHERE file_path <> 'Brand#7') AS entities, (SELECT count(*) FROM hop WHERE src NOT IN (SELECT id FROM sym WHERE file_path = 'Brand#7') AND dst NOT IN (SELECT id FROM sym WHERE file_path = 'Brand#7')) AS edges")
def _(spark, d):
    edges = hops(spark, d).select(F.col("caller").alias("from_id"), F.col("callee").alias("to_id"))
    rest, kept = E.delete_file("Brand#7", symbols(spark, d), edges)
    return rest.agg(F.count("*").alias("entities")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("edges"))))
