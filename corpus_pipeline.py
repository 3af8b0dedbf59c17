"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage works on all that its predecessor kept and takes (spark, docs, sf_dir); all but the last return the columns of
documents, whatever further columns there are and however they are named. A text of any length is read whole by one task, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnspark.llm import decontam, langid, lines, neardup, packing
from cairnspark.llm.common import bounded_batches, let_go, small, table


def _begin(spark: SparkSession) -> None:
    bounded_batches(spark)
    let_go(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject; it learns from the languages that documents have. Null texts and texts
    without a letter go; repeated rows are judged one by one and so stay or go together; a null lang only means not to learn from it."""
    _begin(spark)
    judged = langid.identify(docs, langid.train(docs), carry=True)
    return judged.where(~F.col("rejected")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay elsewhere; a document all of whose lines do goes. Documents without lines that aren't
    blank stay as they are, null and empty ones too; rows with one id and text are treated alike. n_chars, if there, is counted anew."""
    _begin(spark)
    left = lines.deduped(docs).where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id (nulls first), then the least hash of its text.

    Of rows with that id and text the one with the least hash of its other columns stays. Documents without words all stay.
    """
    _begin(spark)
    found = neardup.join(docs, keep_root=True)
    first = F.min(F.struct(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))).alias("of")
    kept = table(found.where("root is not null").groupBy("root").agg(first).select("of.*", F.lit(True).alias("grouped")), "kept")
    wordless = found.where("root is null").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), F.lit(False).alias("grouped")).distinct()
    others = F.xxhash64(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), others.alias("others"))
    both = kept.unionByName(wordless)
    joined = rows.join(both, rows["doc_id"].eqNullSafe(both["kept_id"]) & (rows["text_hash"] == both["kept_hash"]))
    one = joined.where("grouped").groupBy("kept_id", "kept_hash").agg(F.min_by("row", "others").alias("row"))
    return one.select("row.*").unionByName(joined.where(~F.col("grouped")).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked. Null and empty texts have no leak and stay; rows with one id and text go together,
    also where the id is null; without items all stay."""
    _begin(spark)
    leaks = decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("item_ids") > 0)
    leaks = table(leaks.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(leaks["of_id"]) & (rows["text_hash"] == leaks["of_hash"])
    return rows.join(small(leaks), same, "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as pieces of training sequences; a null text counts as empty, and each row is a document."""
    _begin(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL expresses neither the trained model nor the sketches; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
