"""Rust sources without a parser: code without comments and strings, statements by brace depth, impl relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_TOKENS = r"""r#*"[^"]*"#*|"(?:\\.|[^"\\])*"|'(?:\\[^']+|[^'\\])'|//[^\n]*|(?s:/\*.*?\*/)|[^"'/r]+|."""


_ATTRIBUTE = r"#!?\[(?:[^\[\]]|\[[^\]]*\])*\]"


def bare_code(text: Column) -> Column:
    """The text with comments, strings and characters taken out; newlines inside them stay, so lines keep their numbers."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s){_TOKENS}"), 0)
    hidden = lambda t: t.rlike(r"""(?s)^(r#*"|"|//|/\*|'(\\[^']+|[^'\\])'$)""")
    return F.array_join(F.transform(parts, lambda t: F.when(hidden(t), F.regexp_replace(t, r"[^\n]+", "")).otherwise(t)), "")


def statements(files: DataFrame) -> DataFrame:
    """(file, at, head, mark, depth, line) of Rust files (file, content): what stands before each {, } or ;, how many braces are open
    there, and the line where it begins after its attributes. A file's statements are numbered and summed over in order, one row each."""
    pieces = F.regexp_extract_all(bare_code(F.col("content")), F.lit(r"(?s)[^{};]*[{};]"), 0)
    rows = files.select("file", F.posexplode(pieces).alias("at", "piece"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    opened = F.when(F.col("piece").endswith("{"), 1).when(F.col("piece").endswith("}"), -1).otherwise(0)
    lead = F.regexp_extract("piece", rf"^((?:\s|{_ATTRIBUTE})*)", 1)
    return rows.select(
        "file", F.col("at").cast("long").alias("at"), F.trim(F.regexp_replace(F.expr("left(piece, length(piece) - 1)"), r"\s+", " ")).alias("head"), F.right("piece", F.lit(1)).alias("mark"),
        F.coalesce(F.sum(opened).over(before), F.lit(0)).cast("long").alias("depth"), (1 + F.coalesce(F.sum(lines(F.col("piece"))).over(before), F.lit(0)) + lines(lead)).cast("long").alias("line"),
    )


def impl_relations(files: DataFrame, modules: bool = True) -> DataFrame:
    """(file, line, module, type_name, trait_name) of every impl in Rust files (file, content), trait_name null for inherent ones.
    Without `modules` there is no module, and where blocks begin and end isn't looked at.

    Generic parameters, bounds and attributes are left out of names. module is the path of the mod blocks around, joined by ::, empty
    outside all. What stands in comments and strings is no impl.
    """
    found = statements(files)
    text = F.regexp_replace(F.regexp_replace("head", rf"{_ATTRIBUTE}\s*", ""), r"->", "")
    for _ in range(5):
        text = F.regexp_replace(text, r"<[^<>]*>", "")
    heads = found.where("mark = '{'").withColumn("head", F.trim(text))
    impls = heads.where(F.col("head").rlike(r"^(?:(?:pub|unsafe|default|const) )*impl\b"))
    named = F.trim(F.regexp_replace(F.regexp_replace("head", r"^(?:(?:pub|unsafe|default|const) )*impl\b", ""), r"\bwhere\b.*$", ""))
    two = F.split(named, r"\s+for\s+")
    impls = impls.select(
        "file", "at", "line", F.trim(F.element_at(two, -1)).alias("type_name"), F.when(F.size(two) > 1, F.trim(F.regexp_replace(F.get(two, F.lit(0)), "^!", ""))).alias("trait_name")
    )
    if not modules:
        return impls.select("file", "line", "type_name", "trait_name")
    mods = heads.where(F.col("head").rlike(r"\bmod \w+$")).select("file", F.col("at").alias("begin"), F.col("depth").alias("level"), F.regexp_extract("head", r"\bmod (\w+)$", 1).alias("name"))
    closing = found.where("mark = '}'").select("file", F.col("at").alias("close"), (F.col("depth") - 1).alias("level"))
    ends = mods.join(closing, ["file", "level"]).where("close > begin").groupBy("file", "begin", "level", "name").agg(F.min("close").alias("end"))
    around = impls.select("file", "at").join(ends, "file").where("begin < at and at < end").groupBy("file", "at")
    scopes = around.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "name"))), lambda m: m["name"]), "::").alias("module"))
    return impls.join(scopes, ["file", "at"], "left").select("file", "line", F.coalesce("module", F.lit("")).alias("module"), "type_name", "trait_name")


def implements(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type) from a type to the trait it implements, both found by simple name in the relation's own file: the
    least id of symbols (id, file, name) with the name. Inherent impls and names that the file doesn't define give none."""
    first = symbols.groupBy("file", "name").agg(F.min("id").alias("id"))
    of = lambda key, ident: first.select("file", F.col("name").alias(key), F.col("id").alias(ident))
    both = relations.where("trait_name is not null").join(of("type_name", "from_id"), ["file", "type_name"]).join(of("trait_name", "to_id"), ["file", "trait_name"])
    return both.select("from_id", "to_id", F.lit("IMPLEMENTS").alias("edge_type")).distinct()
