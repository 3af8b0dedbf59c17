"""Tables in the folder that driver and executors share; they cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where it is unset and all tasks run on this machine (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named.rstrip("/"))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
    return _own_dir


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each plan that runs inside, once its result is there; no such plan may run a second time."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    # nothing reads this plan's shuffle files once the table is there
    with shuffles_removed(spark):
        # ids and hashes hardly repeat: dictionaries would be built and thrown away
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that table() returned, once nothing reads it any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
