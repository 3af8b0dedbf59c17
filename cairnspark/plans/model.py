"""The data model: typed node and edge tables, and the views of the benchmark tables as such a graph.

entities(id, kind, name, file_path), edges(from_id, to_id, edge_type), call_edges(caller, callee), labels(entity_id, label),
versions(snapshot_id, stable_id, name, kind), cfg_blocks(function_id, block, kind, terminator, start_line, end_line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

SPAN = [T.StructField(n, T.LongType()) for n in ("byte_start", "byte_end", "start_line", "start_col", "end_line", "end_col")]
_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]

#: Payloads of the node kinds; read once from JSON at load, typed afterwards.
PAYLOADS = {
    "File": T.StructType([*_text("path", "hash"), T.StructField("last_indexed_at", T.LongType()), T.StructField("last_modified", T.LongType())]),
    "Symbol": T.StructType([*_text("symbol_id", "fqn", "canonical_fqn", "display_fqn", "name", "kind", "kind_normalized"), *SPAN]),
    "Reference": T.StructType([*_text("file"), *SPAN]),
    "Call": T.StructType([*_text("file", "caller", "callee", "caller_symbol_id", "callee_symbol_id"), *SPAN]),
    "Import": T.StructType(
        [*_text("file", "import_kind"), T.StructField("import_path", T.ArrayType(T.StringType())), T.StructField("imported_names", T.ArrayType(T.StringType())),
         T.StructField("is_glob", T.BooleanType()), *SPAN, T.StructField("resolved_file_id", T.LongType())]
    ),
}


def typed(entities: DataFrame, kind: str) -> DataFrame:
    """Entities of one kind with their JSON payload `data` as typed columns; the own id, kind and name keep their names."""
    rows = entities.where(F.col("kind") == kind).withColumn("payload", F.from_json("data", PAYLOADS[kind]))
    taken = {c.lower() for c in entities.columns}
    fields = [F.col(f"payload.{f.name}").alias(f.name if f.name.lower() not in taken else f"payload_{f.name}") for f in PAYLOADS[kind].fields]
    return rows.select(*[c for c in entities.columns if c != "data"], *fields)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: id, name, kind, file_path, size, price."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file_path"),
        F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: a line item calls the next part of its order. caller, callee, file, place, weight."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(order).alias("callee"), F.col("l_suppkey").alias("file"),
            F.col("l_orderkey").alias("function"), F.col("l_linenumber").cast("long").alias("place"), F.col("l_quantity").alias("weight"),
        )
        .where("callee is not null")
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls (caller, callee)."""
    return sites(spark, sf_dir).select("caller", "callee").distinct()


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: snapshot_id (day of the year), stable_id (user), kind, at (seconds)."""
    return read(spark, sf_dir, "events").select(
        F.dayofyear("ts").cast("long").alias("snapshot_id"), F.col("user_id").alias("stable_id"), F.col("event_type").alias("kind"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as blocks of a function: function_id, block, kind, start_line, end_line."""
    lines = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size(F.split("text", "\n")).cast("long")
    before = F.coalesce(F.sum(size).over(lines), F.lit(0))
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("function_id"), F.col("turn").cast("long").alias("block"), F.col("role").alias("kind"), "text",
        (before + 1).alias("start_line"), (before + size).alias("end_line"),
    )
