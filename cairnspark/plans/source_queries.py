"""Queries of conditions, modules, imports, command lines and ignore files, over sources made of the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shell import shell_split, useful_flags
from ..operators import conditions as C, modules as M
from ..sources import ignore as I
from .catalog import query
from .model import read

_F = "feature = \"' || {0} || '\""
_CONDITION = f"""CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN '{_F.format("p_type")}' WHEN 2 THEN 'not({_F.format("p_type")})'
  WHEN 3 THEN 'all({_F.format("p_type")}, not({_F.format("p_brand")}))' WHEN 4 THEN 'any(not(all({_F.format("p_type")}, unix)), {_F.format("p_brand")})'
  WHEN 5 THEN 'not(target_os = "x")' WHEN 6 THEN 'all(any({_F.format("p_type")}, {_F.format("p_brand")}), not(any({_F.format("p_name")}, not(unix))))' ELSE 'unix' END"""
_ACTIVE = ("PROMO", "SMALL", "Brand#2", "Brand#7", "Brand#17", "red widget")


@query(
    "p25_nested_conditions",
    f"""WITH p AS (SELECT p_partkey AS id, p_size % 8 AS k, p_type IN {_ACTIVE} AS t, p_brand IN {_ACTIVE} AS b, p_name IN {_ACTIVE} AS n FROM part)
      SELECT id, CASE k WHEN 0 THEN true WHEN 1 THEN t WHEN 2 THEN NOT t WHEN 3 THEN t AND NOT b WHEN 4 THEN NOT t OR b WHEN 5 THEN false WHEN 6 THEN (t OR b) AND NOT n ELSE true END AS live FROM p""",
)
def _(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), C.is_live(F.expr(_CONDITION), _ACTIVE).alias("live"))


@query(
    "p26_function_conditions",
    """SELECT p_brand AS file, 'f' || p_partkey AS function, CASE p_size % 4 WHEN 0 THEN 'feature = "' || p_type || '"' WHEN 1 THEN 'all(unix, not(feature = "' || p_name || '"))' WHEN 2 THEN 'windows' END AS condition,
      CAST(l.linenumber AS BIGINT) AS block FROM part JOIN (SELECT l_partkey, l_linenumber AS linenumber FROM lineitem GROUP BY 1, 2) l ON l_partkey = p_partkey""",
)
def _(spark, d):
    attributes = F.expr("""CASE p_size % 4 WHEN 0 THEN '#[inline]\\n#[cfg(feature = "' || p_type || '")]\\n' WHEN 1 THEN '#[cfg(unix)]\\n  #[cfg( all(unix, not(feature = "' || p_name || '")) )]\\n#[must_use]\\n'
      WHEN 2 THEN '#[cfg(windows)] ' ELSE '#[cfg(test)]\\nmod t {}\\n#[inline]\\n' END""")
    source = F.concat(attributes, F.lit("pub fn f"), F.col("p_partkey").cast("string"), F.lit("() { if x { y() } }\n"))
    conditions = C.function_conditions(read(spark, d, "part").select(F.col("p_brand").alias("file"), source.alias("content")))
    lines = read(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").cast("long").alias("block")).distinct()
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("function"))
    return C.inherited(lines.join(parts, "l_partkey").drop("l_partkey"), conditions).select("file", "function", "condition", "block")


#: Files of a crate per brand: its root, a folder with mod.rs for each type, and a file for each part.
_FILES = """SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'src/lib.rs' WHEN p_size % 10 = 1 THEN '/w/src/' || p_type || '/mod.rs' ELSE '/w/src/' || p_type || '/p' || p_partkey || '.rs' END AS file,
  CASE WHEN p_size % 10 = 0 THEN 'crate' WHEN p_size % 10 = 1 THEN 'crate::' || p_type ELSE 'crate::' || p_type || '::p' || p_partkey END AS module, p_type AS type FROM part"""
_JUMPS = """SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS b FROM lineitem"""


@query(
    "j14_resolved_imports",
    f"""WITH f AS ({_FILES}), j AS (SELECT * FROM ({_JUMPS}) WHERE b IS NOT NULL), i AS (SELECT o, n, x.module AS home, x.file AS file, y.module AS other, y.type AS type, 'p' || b AS leaf, n % 6 AS k FROM j JOIN f x ON x.id = a JOIN f y ON y.id = b),
      w AS (SELECT *, CASE k WHEN 0 THEN other WHEN 1 THEN 'crate::' || type WHEN 2 THEN home || '::' || leaf WHEN 3 THEN CASE WHEN home <> 'crate' THEN array_to_string(string_split(home, '::')[:-2], '::') || '::' || leaf END
        WHEN 4 THEN CASE WHEN len(string_split(home, '::')) > 2 THEN array_to_string(string_split(home, '::')[:-3], '::') || '::' || type END ELSE 'crate::' || type || '::' || leaf END AS module FROM i),
      m AS (SELECT module, min(id) AS target FROM f GROUP BY 1)
      SELECT o, CAST(n AS BIGINT) AS n, file, CASE k WHEN 0 THEN 'use_crate' WHEN 1 THEN 'use_crate' WHEN 2 THEN 'use_self' WHEN 3 THEN 'use_super' WHEN 4 THEN 'use_super' ELSE 'plain_use' END AS kind, w.module, target FROM w LEFT JOIN m ON m.module = w.module""",
)
def _(spark, d):
    files = spark.sql(_FILES.replace("FROM part", "FROM {part}"), part=read(spark, d, "part").select("p_partkey", "p_size", "p_type"))
    jumps = spark.sql(_JUMPS.replace("FROM lineitem", "FROM {line}"), line=read(spark, d, "lineitem")).where("b is not null")
    of = files.select(F.col("id").alias("a"), "file")
    to = files.select(F.col("id").alias("b"), F.split("module", "::").alias("other"), "type")
    leaf, k = F.concat(F.lit("p"), F.col("b").cast("string")), F.col("n") % 6
    path = (
        F.when(k == 0, F.col("other")).when(k == 1, F.array(F.lit("crate"), "type")).when(k == 2, F.array(F.lit("self"), leaf)).when(k == 3, F.array(F.lit("super"), leaf))
        .when(k == 4, F.array(F.lit("super"), F.lit("super"), "type")).otherwise(F.array("type", leaf))
    )
    asked = jumps.join(of, "a").join(to, "b").select("o", F.col("n").cast("long").alias("n"), "file", path.alias("path"))
    return M.resolve_imports(asked, files.select("id", "file")).select("o", "n", "file", "kind", "module", "target")


@query(
    "s7_use_trees",
    """WITH p AS (SELECT 'f' || page_id AS file, regexp_extract_all(url, '[a-z]+') AS w FROM pages), r AS (SELECT file, w, len(w) AS n FROM p)
      SELECT file, 'crate::' || w[1] || '::' || w[2] AS path, false AS is_glob, 'use_crate' AS kind FROM r UNION ALL SELECT file, 'crate::' || w[1], false, 'use_crate' FROM r
      UNION ALL SELECT file, 'crate::' || w[1] || '::' || w[3] || '::' || w[n], false, 'use_crate' FROM r UNION ALL SELECT file, 'super::' || w[2], true, 'use_super' FROM r UNION ALL SELECT file, w[3], false, 'plain_use' FROM r""",
)
def _(spark, d):
    w = F.regexp_extract_all("url", F.lit("[a-z]+"), 0)
    at = lambda i: F.element_at(w, i)
    source = F.concat(
        F.lit("//! use none::none;\nuse crate::"), at(1), F.lit("::{self, "), at(2), F.lit(" as x, "), at(3), F.lit("::{\n"), at(-1), F.lit("\n}};\npub use super::"), at(2), F.lit("::*;\nuse ::"), at(3), F.lit(";\n")
    )
    rows = read(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file"), source.alias("content"))
    return M.use_statements(rows).select("file", F.array_join("path", "::").alias("path"), "is_glob", "kind")


@query(
    "x13_shell_words",
    """SELECT conv_id, turn, 'cc|-I|' || role || ' x|-DM=' || replace(replace(coalesce(text, ''), '"', ''), chr(39), '') || '|-o|a b|-isystem|q|-c|-fPIC' || turn AS words, '-I|' || role || ' x|-DM=' || replace(replace(coalesce(text, ''), '"', ''), chr(39), '') || '|-isystem|q|-fPIC' || turn AS flags FROM conversations""",
)
def _(spark, d):
    bare = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))
    line = F.concat(F.lit(' cc  -I "'), F.col("role"), F.lit(' x" -D"M="\''), bare, F.lit("' -o 'a'\" \"b\t-isystem q -c \"-fPIC\""), F.col("turn").cast("string"), F.lit(" ''\n"))
    words = read(spark, d, "conversations").select("conv_id", "turn", shell_split(line).alias("w"))
    return words.select("conv_id", "turn", F.array_join("w", "|").alias("words"), F.array_join(useful_flags(F.col("w")), "|").alias("flags"))


#: Ignore files: folder, rank, content.
_IGNORE = [
    ("", 0, "# made things\n*.html\n!keep.html\n/de/\nfr/**/1*\n\n"), ("", 1, "tmp\n"), ("en", 0, "!5*\n[!0-9]*\n/7?\n"),
]
_TREE = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*[^?#/])', 1)"


@query(
    "s2_ignore_files",
    f"""WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM (SELECT {_TREE} || (CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '/keep.html' WHEN 2 THEN '/tmp/x' WHEN 3 THEN '/a' ELSE '' END) AS path FROM pages WHERE {_TREE} <> '')),
      e AS (SELECT path, s, i, array_to_string(s[1:i], '/') AS entity, s[i] AS name, i < len(s) AS folder FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)),
      v AS (SELECT *, CASE WHEN s[1] = 'en' AND i > 1 AND i = 2 AND regexp_matches(name, '^7.$') THEN true WHEN s[1] = 'en' AND i > 1 AND regexp_matches(name, '^[^0-9]') THEN true WHEN s[1] = 'en' AND i > 1 AND starts_with(name, '5') THEN false
        WHEN name = 'tmp' THEN true WHEN s[1] = 'fr' AND i > 1 AND starts_with(name, '1') THEN true WHEN folder AND i = 1 AND name = 'de' THEN true WHEN name = 'keep.html' THEN false WHEN ends_with(name, '.html') THEN true ELSE false END AS gone FROM e)
      SELECT path, min(entity) AS by FROM v WHERE gone GROUP BY 1""",
)
def _(spark, d):
    ends = F.expr(f"{_TREE} || (CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '/keep.html' WHEN 2 THEN '/tmp/x' WHEN 3 THEN '/a' ELSE '' END)")
    paths = read(spark, d, "pages").where(F.expr(f"{_TREE} <> ''")).select(ends.alias("path")).distinct()
    return I.ignored(paths, I.rules(spark.createDataFrame(_IGNORE, "folder string, rank long, content string")))
