"""Queries of the stored indexes: words and phrases over documents, vectors, and pairs of similar ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C, vectors as V
from .catalog import query
from .model import read
from .storage import table

#: Up to so many questions are sent to the texts.
FEW = 100_000
_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
#: Two queries for each benchmark item: a phrase with a word, and two words.
_ASKED = f"""d AS (SELECT doc_id AS id, {_TOKENS.format("coalesce(text, '')")} AS t FROM documents), bt AS (SELECT item_id, {_TOKENS.format("text")} AS t FROM benchmark),
  u AS (SELECT item_id * 2 AS qid, t[1] AS a, t[2] AS b FROM bt UNION SELECT item_id * 2, t[4], NULL FROM bt UNION SELECT item_id * 2 + 1, t[1], NULL FROM bt UNION SELECT item_id * 2 + 1, t[3], NULL FROM bt),
  w AS (SELECT id, len(t) AS length, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM d),
  h AS (SELECT a, NULL AS b, id, length, count(*) AS tf FROM w JOIN (SELECT DISTINCT a FROM u WHERE b IS NULL) ON a = term GROUP BY ALL
    UNION ALL SELECT a, b, x.id, x.length, count(*) FROM (SELECT DISTINCT a, b FROM u WHERE b IS NOT NULL) JOIN w x ON x.term = a JOIN w y ON y.id = x.id AND y.i = x.i + 1 AND y.term = b GROUP BY ALL),
  df AS (SELECT a, b, count(*) AS df FROM h GROUP BY 1, 2), n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), nu AS (SELECT qid, count(*) AS k FROM u GROUP BY 1),
  s AS (SELECT qid, id, count(*) AS k, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS bm25
    FROM u JOIN h ON h.a = u.a AND h.b IS NOT DISTINCT FROM u.b JOIN df ON df.a = u.a AND df.b IS NOT DISTINCT FROM u.b, n GROUP BY 1, 2),
  r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY bm25, id) AS rank, bm25 FROM s JOIN nu USING (qid, k))"""


def _asked(spark, d):
    t = C.index_tokens(F.col("text"))
    at = lambda i: F.element_at(t, i)
    # capitals ask for the same word where they lead back to it; those of ß are SS. Spark takes lower(upper(x)) for lower(x), so a
    # space is put between the two
    back = F.lower(F.concat(F.upper(at(1)), F.lit(" ")))
    capitals = F.when(back == F.concat(at(1), F.lit(" ")), F.upper(at(1))).otherwise(at(1))
    one = F.struct((F.col("item_id") * 2).alias("qid"), F.concat(F.lit('"'), capitals, F.lit(", "), at(2), F.lit('" '), at(4)).alias("query"))
    two = F.struct((F.col("item_id") * 2 + 1).alias("qid"), F.concat_ws(" ", at(3), at(1)).alias("query"))
    return read(spark, d, "benchmark").select(F.explode(F.array(one, two)).alias("q")).select("q.*")


def _hits(spark, d):
    index = C.load(spark, C.build(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))
    return C.search(index, _asked(spark, d), 10)


@query("f2_indexed", f"WITH {_ASKED} SELECT qid, id, rank, bm25 FROM r WHERE rank <= 10")
def _(spark, d):
    return _hits(spark, d)


@query(
    "f2_excerpts",
    f"""WITH {_ASKED}, x AS (SELECT qid, rank, text, lower(text) AS l, t FROM r JOIN documents ON doc_id = id JOIN bt ON item_id = qid // 2 WHERE rank = 1),
      p AS (SELECT qid, text, list_filter([instr(l, v) for v in CASE WHEN qid % 2 = 0 THEN [t[1] || ',', t[2], t[4]] ELSE [t[3], t[1]] END if len(v) > 1], lambda i: i > 0) AS found FROM x),
      b AS (SELECT qid, text, greatest(coalesce(found[1], 1) - 101, 0) AS b FROM p)
      SELECT qid, (CASE WHEN b > 0 THEN '...' ELSE '' END) || substring(text, b + 1, 200) || (CASE WHEN b + 200 < length(text) THEN '...' ELSE '' END) AS excerpt FROM b""",
)
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    first = table(_hits(spark, d).where("rank = 1").join(_asked(spark, d), "qid").select("qid", "id", "query"), "first-hits")
    # a row for each question; few are sent to the texts, which are then not shuffled
    first = F.broadcast(first) if first.count() <= FEW else first
    return docs.join(first, "id").select("qid", C.excerpt(F.col("text"), F.col("query")).alias("excerpt"))


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    "f8_indexed",
    f"""SELECT qid, id, similarity, rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, round({_COSINE}, 6) AS similarity,
      row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COSINE}, 6) DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE rank <= 10""",
)
def _(spark, d):
    e = read(spark, d, "embeddings")
    index = V.load(spark, V.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))))
    return V.nearest(index, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 10, exact=True)


@query("j20_projected", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label < b.label WHERE {_COSINE} >= 0.35")
def _(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vec"))
    return V.similar_by_projection(rows, 0.35, recall=0.99999, bits=5).select("a", "b", V.four_places(F.col("cosine")).alias("cosine"))
