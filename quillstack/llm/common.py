"""Helpers shared by the corpus operators: shared tables, word handling and small numeric tools."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts define them (ASCII white space only).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one of our own where it is unset.

    Unset on a local master (tests): a temporary folder removed at exit. Unset on a
    cluster: a folder in the SQL warehouse, which is shared by definition.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            path = tempfile.mkdtemp(prefix="quillstack-")
            atexit.register(shutil.rmtree, path, True)
            _own[app] = "file://" + path
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillstack_scratch"
    return _own[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillstack/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table: cuts
    lineage, survives lost executors, and makes later readers see one fixed state."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: all that was made of them has been written itself."""
    for t in tables:
        path = getattr(t, "_table_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(col) -> "F.Column":
    """Number of words of a text column; 0 for null."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD_PATTERN))
