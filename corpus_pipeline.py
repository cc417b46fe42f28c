"""The corpus pipeline: documents judged, thinned of near copies and of repeated passages, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and
returns a DataFrame; run() writes each stage's result as Parquet in the shared folder and
reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack import attach
from quillstack.llm import jaccard, mixing, packing, quality, spans
from quillstack.llm.common import forget, table, written

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Rows are judged one by one, so that of rows with one id those that are good stay; rows
    without an id are judged like any other. Null, empty and blank texts have no words to
    judge and go. Very long texts are judged whole. Repeated rows are judged alike and
    all stay, or go. Empty table, or no labels of one value: no row goes for its evidence.
    """
    attach(spark)
    judged = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    rejected = written(judged.where(~F.col("kept")).select(F.struct("doc_id", "text_sum", "host", "path").alias("is")).distinct(), "pipeline-rejected")
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_sum"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row.alias("is"))
    return rows.join(rejected, "is", "left_anti").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, the one with the smallest id.

    A document is an id with a text: an id's other texts stay if nothing is similar to
    them. Of repeated rows one stays. Rows without an id are compared and give way to
    those with one. Null, empty and blank texts are similar to nothing and stay. Very
    long texts are compared whole. Empty table: no rows.
    """
    attach(spark)
    return jaccard.one_of_each(docs, k=SHINGLE, percent=PERCENT)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: sentences of non-first repeated spans go, and documents of which nothing is left.

    Repeated rows, and rows with the same id and text, are one document and keep or lose
    the same sentences. Rows without an id are told apart by their texts. Null, empty and
    blank texts stay as they are. Very long texts are read whole. Empty table: no rows.
    """
    attach(spark)
    done = spans.remove_repeats(docs)
    done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where("n_removed = 0 OR text <> ''").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weighted fair queueing: documents in the order of the mix, a row for each time that one is taken.

    Null source: a source of its own, last in order. Null, empty and blank texts have no
    words and aren't taken. Repeated rows and rows without an id are rows of their own;
    ties in the shuffling hash go by size and content. The last document of a source is
    cut at its target, a very long one too. Empty table: no rows.
    """
    attach(spark)
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for each piece of a document, with its bin.

    Texts over the capacity are several pieces. Null, empty and blank texts: one piece of
    no words in no bin. Null source: a source of its own. Repeated rows and rows without
    an id are rows of their own; ties in size go by id, piece and cluster. Empty table:
    no rows.
    """
    attach(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_spans),
    ("mixing", mix_sources),
    ("best-fit packing", pack_bins),
]

#: A classifier is fitted on the way, which SQL can't express; tests/llm/test_entries.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
