"""Exports: one wide record table, tagged JSON lines, DOT, and LSIF- and SCIP-shaped tables. Each is a DataFrame to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def records(**frames: DataFrame) -> DataFrame:
    """All frames as one nullable wide table with record_type."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("record_type", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def json_lines(version: str, **frames: DataFrame) -> DataFrame:
    """A version record, then one JSON record per row: (line)."""
    spark = next(iter(frames.values())).sparkSession
    out = spark.range(1).select(F.to_json(F.struct(F.lit("version").alias("record_type"), F.lit(version).alias("version"))).alias("line"))
    for name, df in frames.items():
        out = out.unionByName(df.select(F.to_json(F.struct(F.lit(name).alias("record_type"), *df.columns)).alias("line")))
    return out


def dot_text(c: Column) -> Column:
    """Text inside a quoted DOT label."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")


def dot_lines(calls: DataFrame, files: DataFrame | None = None, file: str | None = None, symbol: str | None = None) -> DataFrame:
    """Lines of a DOT graph for calls (caller, callee as text): (section, line); sorted by both they are the file.

    With files (node, file) every file is a cluster: its opening and its nodes share a section and the order of its name. Only
    calls that touch a file or a symbol are kept if one is named.
    """
    if file is not None and files is not None:
        here = files.where(F.col("file") == file).select("node")
        calls = calls.join(here.withColumnRenamed("node", "caller"), "caller", "left_semi").unionByName(calls.join(here.withColumnRenamed("node", "callee"), "callee", "left_semi")).distinct()
    if symbol is not None:
        calls = calls.where((F.col("caller") == symbol) | (F.col("callee") == symbol))
    quote = lambda c: F.concat(F.lit('"'), dot_text(c), F.lit('"'))
    nodes = calls.select(F.explode(F.array("caller", "callee")).alias("n")).distinct().select(F.lit(1).alias("section"), F.concat(F.lit("  "), quote(F.col("n")), F.lit(";")).alias("line"))
    edges = calls.select("caller", "callee").distinct().select(F.lit(2).alias("section"), F.concat(F.lit("  "), quote(F.col("caller")), F.lit(" -> "), quote(F.col("callee")), F.lit(";")).alias("line"))
    spark = calls.sparkSession
    frame = spark.createDataFrame([(0, "digraph {"), (3, "}")], "section int, line string")
    if files is not None:
        # one line a cluster; its nodes are listed in it, as many as the file has
        used = calls.select(F.explode(F.array("caller", "callee")).alias("node")).distinct().join(files, "node")
        listed = F.array_join(F.sort_array(F.collect_list(F.concat(quote(F.col("node")), F.lit(";")))), " ")
        clusters = used.groupBy("file").agg(listed.alias("nodes"))
        nodes = clusters.select(F.lit(1).alias("section"), F.concat(F.lit("  subgraph "), quote(F.concat(F.lit("cluster_"), F.col("file"))), F.lit(" { label="), quote(F.col("file")), F.lit("; "), "nodes", F.lit(" }")).alias("line"))
    return frame.unionByName(nodes).unionByName(edges)


def impact_json(hits: DataFrame) -> DataFrame:
    """An export of impact rows (name, file_path, depth): (line), one JSON record each, with their number in a last record."""
    rows = hits.select(F.to_json(F.struct(F.lit("impact").alias("record_type"), "depth", "file_path", "name")).alias("line"))
    total = hits.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return rows.unionByName(total.select(F.to_json(F.struct(F.lit("summary").alias("record_type"), "n", "max_depth")).alias("line")))


def collision_json(symbols: DataFrame, by: str) -> DataFrame:
    """An export of all values that several symbols (id, ...) share in a naming column: (line), one JSON record for each value with its
    number and, in order, the ids of its first 100 symbols; the rest are the symbols' own rows with `part` from 1 on."""
    w = Window.partitionBy(by).orderBy("id")
    rows = symbols.where(F.col(by).isNotNull()).select(F.col(by).alias("value"), "id", F.floor((F.row_number().over(w) - 1) / 100).cast("long").alias("part"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    listed = rows.where("n > 1").groupBy("value", "n", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return listed.select(F.to_json(F.struct(F.lit("collision").alias("record_type"), F.lit(by).alias("field"), "value", "n", "part", "ids")).alias("line"))


def lsif(symbols: DataFrame, project: str) -> DataFrame:
    """Vertices and edges of an LSIF dump: label, kind ('vertex' or 'edge'), key, out_key. Keys are text, so nothing is numbered in
    one place: package, file:path, symbol:id."""
    spark = symbols.sparkSession
    package = spark.createDataFrame([("package", "vertex", f"package:{project}", None)], "label string, kind string, key string, out_key string")
    files = symbols.select("file_path").distinct()
    file_key, symbol_key = F.concat(F.lit("file:"), F.col("file_path")), F.concat(F.lit("symbol:"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    return (
        package.unionByName(files.select(F.lit("document").alias("label"), F.lit("vertex").alias("kind"), file_key.alias("key"), none.alias("out_key")))
        .unionByName(symbols.select(F.lit("symbol").alias("label"), F.lit("vertex").alias("kind"), symbol_key.alias("key"), none.alias("out_key")))
        .unionByName(symbols.select(F.lit("contains").alias("label"), F.lit("edge").alias("kind"), symbol_key.alias("key"), file_key.alias("out_key")))
    )


def scip(symbols: DataFrame, project: str, version: str) -> DataFrame:
    """Occurrences of a SCIP index as a table: document, symbol (scheme, package, version, path and name), ordinal in its document."""
    name = F.concat(F.lit(f"cairn . {project} {version} "), F.regexp_replace("file_path", "[^A-Za-z0-9_/.-]", "_"), F.lit("/"), F.regexp_replace("name", "[^A-Za-z0-9_$+-]", "_"), F.lit("()."))
    w = Window.partitionBy("file_path").orderBy("id")
    return symbols.select(F.col("file_path").alias("document"), name.alias("symbol"), F.row_number().over(w).cast("long").alias("ordinal"))


def graph_json(**frames: DataFrame) -> DataFrame:
    """One JSON document per file of all frames (file_path and more): a file's lists are sorted, so no list spans the corpus."""
    out = None
    for name, df in frames.items():
        cols = [c for c in df.columns if c != "file_path"]
        listed = df.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = listed if out is None else out.join(listed, "file_path", "full_outer")
    return out.select("file_path", F.to_json(F.struct("*")).alias("json"))


def delete_file(path: str, entities: DataFrame, edges: DataFrame, *side_tables: DataFrame) -> tuple[DataFrame, ...]:
    """All tables without a file's entities, the edges that touch them, and its rows in side tables with file_path."""
    gone = entities.where(F.col("file_path") == path).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    rest = lambda t: t.where(~F.col("file_path").eqNullSafe(path))
    return rest(entities), kept, *(rest(t) for t in side_tables)
