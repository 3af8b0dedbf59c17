"""Queries of bounded paths, hop search, answers within a budget, symbol details and Rust relations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import context as C, paths as P
from ..sources import rust as R
from .catalog import query
from .graph_queries import _edges, _least
from .model import read, symbols
from .text_queries import _TOK

_WALKS = """WITH RECURSIVE start AS (SELECT min(src) AS node FROM hop), p AS (SELECT [node] AS path FROM start UNION ALL SELECT list_append(path, h.dst) FROM p JOIN hop h ON h.src = path[-1]
  WHERE NOT list_contains(path, h.dst) AND len(path) < 4 AND (len(path) = 1 OR path[-1] % 20 <> 0)),
  f AS (SELECT path, len(path) AS length, row_number() OVER (ORDER BY len(path), path) AS n FROM p WHERE len(path) BETWEEN 2 AND 3 AND path[-1] % 20 = 0)"""


def _bounded(spark, d):
    e = _edges(spark, d)
    exits = e.where("dst % 20 = 0").select(F.col("dst").alias("node")).distinct()
    return P.enumerate_paths(e, _least(spark, d), 4, 50, exits)


@query("a11_bounded_paths", f"{_WALKS} SELECT array_to_string(path, '>') AS path, length FROM f WHERE n <= 50")
def _(spark, d):
    return _bounded(spark, d)[0].select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


@query(
    "a11_path_statistics",
    f"""{_WALKS} SELECT (SELECT count(*) FROM f) AS total, count(*) AS kept, coalesce(avg(length), 0) AS average, coalesce(min(length), 0) AS least, coalesce(max(length), 0) AS greatest,
      (SELECT count(*) > 0 FROM p WHERE len(path) = 4) AS bound_hit, (SELECT count(DISTINCT x) FROM (SELECT unnest(path) AS x FROM f WHERE n <= 50)) AS nodes FROM f WHERE n <= 50""",
)
def _(spark, d):
    return _bounded(spark, d)[1]


_SEEDS = f"""t AS (SELECT id, name FROM sym WHERE len(list_filter({_TOK.format("name")}, lambda t: starts_with(t, 're'))) > 0 ORDER BY length(name), id LIMIT 20),
  seed AS (SELECT id AS node, round(1 - 0.5 * (row_number() OVER (ORDER BY length(name), id) - 1) / count(*) OVER (), 6) AS score FROM t)"""


@query(
    "a13_hop_search",
    f"""WITH RECURSIVE {_SEEDS}, down AS (SELECT node, score, 0 AS d FROM seed UNION SELECT h.dst, score * 0.7, d + 1 FROM down JOIN hop h ON h.src = node WHERE d < 2 AND (d = 0 OR node NOT IN (SELECT node FROM seed))),
      up AS (SELECT node, score, 0 AS d FROM seed UNION SELECT h.src, score * 0.7, d + 1 FROM up JOIN hop h ON h.dst = node WHERE d < 2 AND (d = 0 OR node NOT IN (SELECT node FROM seed))),
      a AS (SELECT * FROM down UNION ALL SELECT * FROM up), b AS (SELECT node, max(struct_pack(score := score, near := -d)) AS best FROM a WHERE d = 0 OR node NOT IN (SELECT node FROM seed) GROUP BY 1)
      SELECT id, name, round(best.score, 6) AS score, CAST(-best.near AS BIGINT) AS distance FROM b JOIN sym ON id = node ORDER BY score DESC, id LIMIT 20""",
)
def _(spark, d):
    return P.hop_search(symbols(spark, d), _edges(spark, d), "re", 10, 2)


@query(
    "a16_symbol_rows",
    """WITH RECURSIVE t AS (SELECT min(id) AS target FROM sym GROUP BY file_path), up AS (SELECT target, target AS id, CAST(0 AS BIGINT) AS depth FROM t UNION SELECT target, h.src, depth + 1 FROM up JOIN hop h ON h.dst = id WHERE depth < 2),
      down AS (SELECT target, target AS id, CAST(0 AS BIGINT) AS depth FROM t UNION SELECT target, h.dst, depth + 1 FROM down JOIN hop h ON h.src = id WHERE depth < 2),
      r AS (SELECT target, o.id, row_number() OVER (PARTITION BY target ORDER BY o.id) AS n FROM t JOIN sym s ON s.id = target JOIN sym o ON o.file_path = s.file_path AND o.id <> target),
      a AS (SELECT target, 'caller' AS section, id, min(depth) AS depth FROM up GROUP BY 1, 3 HAVING min(depth) > 0 UNION ALL SELECT target, 'callee', id, min(depth) FROM down GROUP BY 1, 3 HAVING min(depth) > 0 UNION ALL SELECT target, 'related', id, 0 FROM r WHERE n <= 10)
      SELECT target, section, a.id, name, file_path AS file, depth FROM a JOIN sym s ON s.id = a.id""",
)
def _(spark, d):
    s = symbols(spark, d).withColumnRenamed("file_path", "file")
    return P.symbol_details(s.select("id", "name", "file"), _edges(spark, d), s.groupBy("file").agg(F.min("id").alias("target")).select("target"), 2)


_ENTRY = "SELECT id, name, file_path, CASE WHEN size = 7 THEN 'main' WHEN size = 11 THEN 'lib' END AS label FROM sym"


@query(
    "g11_entry_points",
    f"""WITH e AS (SELECT * FROM ({_ENTRY}) WHERE label IS NOT NULL ORDER BY label DESC, file_path, name, id LIMIT 20), l AS (SELECT string_agg(name || ' (' || file_path || ')', ',' ORDER BY label DESC, file_path, name, id) AS entry_points FROM e)
      SELECT count(*) AS symbols, count(DISTINCT file_path) AS files, any_value(entry_points) AS entry_points FROM sym, l""",
)
def _(spark, d):
    s = symbols(spark, d)
    labels = s.select("id", F.when(F.col("size") == 7, "main").when(F.col("size") == 11, "lib").otherwise("other").alias("label"))
    found = P.entry_points(s.select("id", "name", F.col("file_path").alias("file")), labels)
    sums = s.agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))
    return sums.crossJoin(F.broadcast(found.select(F.array_join("entry_points", ",").alias("entry_points"))))


@query(
    "o6_fitted_answers",
    """WITH r AS (SELECT file_path, name, id, row_number() OVER (PARTITION BY file_path ORDER BY name, id) AS n FROM sym), g AS (SELECT file_path, list(name ORDER BY n) FILTER (n <= 16) AS items, count(*) AS total FROM r GROUP BY 1),
      q AS (SELECT *, 10 + 4 * CAST(regexp_extract(file_path, '[0-9]+') AS BIGINT) AS tokens, 'Project: ' || file_path || chr(10) AS head, 'Project ID: ' || total || chr(10) || '---' || chr(10) AS tail FROM g),
      a AS (SELECT *, [head || (CASE WHEN len(items[:k]) > 0 AND k > 0 THEN 'Entry Points:' || chr(10) || array_to_string(['  - ' || x || chr(10) for x in items[:k]], '') || chr(10) ELSE '' END) || tail
        || (CASE WHEN len(items) > 15 OR k < 15 THEN chr(10) || '... [Output truncated due to token budget]' || chr(10) ELSE '' END) for k in [15, 7, 3, 1, 0]] AS s FROM q)
      SELECT file_path, coalesce(list_filter(s, lambda x: strlen(x) <= 4 * tokens)[1], substring(s[5], 1, greatest(4 * tokens - 60, 0)) || chr(10) || '... [Output truncated due to --token-budget]') AS answer FROM a""",
)
def _(spark, d):
    w = Window.partitionBy("file_path")
    rows = symbols(spark, d).select("file_path", "name", F.row_number().over(w.orderBy("name", "id")).alias("n"))
    # one more than the cap is enough to see that something is cut
    few = rows.groupBy("file_path").agg(F.sort_array(F.collect_list(F.when(F.col("n") <= C.CAPS["normal"] + 1, F.struct("n", "name")))).alias("items"), F.count("*").alias("total"))
    tokens = 10 + 4 * F.regexp_extract("file_path", "[0-9]+", 0).cast("int")
    head, tail = F.concat(F.lit("Project: "), F.col("file_path"), F.lit("\n")), F.concat(F.lit("Project ID: "), F.col("total").cast("string"), F.lit("\n---\n"))
    return few.select("file_path", C.fitted_summary(head, F.transform("items", lambda x: x["name"]), tail, tokens).alias("answer"))


_RUST = """'/* impl A for B {\\n */ struct S' || p_partkey || ';\\ntrait T' || p_partkey || ' {}\\nmod outer {\\n mod ' || lower(p_type) || ' {\\n  #[cfg(a)]\\n  impl<''a, X: Into<Y<Z>>> T' || p_partkey
  || ' for S' || p_partkey || '<''a, X>\\n  where X: Q { fn f() -> u8 { let s = "impl Q for R {"; let c = ''{''; } }\\n }\\n // impl No {\\n unsafe impl Send for S' || p_partkey || ' {}\\n}\\nimpl S' || p_partkey || ' { fn g() {} }\\n'"""
_IMPLS = """i AS (SELECT p_partkey AS file, 7 AS line, 'outer::' || lower(p_type) AS module, 'S' || p_partkey AS type_name, 'T' || p_partkey AS trait_name FROM part
  UNION ALL SELECT p_partkey, 11, 'outer', 'S' || p_partkey, 'Send' FROM part UNION ALL SELECT p_partkey, 13, '', 'S' || p_partkey, NULL FROM part)"""


def _rust(spark, d):
    # a file of parts is small and so one task, its texts are long to read
    parts = read(spark, d, "part").select("p_partkey", "p_type").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select(F.col("p_partkey").alias("file"), F.expr(_RUST).alias("content"))


@query("s8_impl_relations", f"WITH {_IMPLS} SELECT file, CAST(line AS BIGINT) AS line, module, type_name, trait_name FROM i")
def _(spark, d):
    return R.impl_relations(_rust(spark, d))


@query("s8_implements", "SELECT 2 * p_partkey AS from_id, 2 * p_partkey + 1 AS to_id, 'IMPLEMENTS' AS edge_type FROM part WHERE p_size % 3 <> 0")
def _(spark, d):
    ident = F.col("p_partkey")
    own = lambda letter, n: F.struct((2 * ident + n).alias("id"), ident.alias("file"), F.concat(F.lit(letter), ident.cast("string")).alias("name"))
    # a third of the files doesn't define the trait
    named = read(spark, d, "part").select(F.explode(F.when(F.col("p_size") % 3 == 0, F.array(own("S", 0))).otherwise(F.array(own("S", 0), own("T", 1)))).alias("s")).select("s.*")
    return R.implements(R.impl_relations(_rust(spark, d), modules=False), named)
