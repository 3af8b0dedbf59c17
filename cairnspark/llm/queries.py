"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, langid, lines, merkle, neardup, packing, pieces, quality, ranked, rules, secrets, sql, sstable, urls
from .common import bounded_batches


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _vocabulary())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.by_crc(5, 0)
    scored = quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), held_out)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin(*(r.kind for r in secrets.BASE_RULES)))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("findings")).alias("spans"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), quality.by_crc(4, 2)
    judged = langid.identify(docs, langid.train(docs, held_out))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "class_distance", "word_distance"
    )


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(_read(spark, sf_dir, "documents"), _vocabulary())
    return sstable.read(spark, manifest).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(_read(spark, sf_dir, "documents")).drop("text_hash")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"), merkle.without_newlines())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup, op2_packing, op3_decontamination, op4_quality, op5_secrets, op6_language, op7_rules, op8_token_shards, op9_urls, op10_near_duplicates,
        op11_ranked_search, op12_token_counts, op13_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_ranked_search": sql.RANKED, "op13_manifest": sql.MERKLE}
