"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a fixed pseudo-random order; a source whose
target exceeds its size queues its documents again. A document's virtual finish time is
the words of its source up to its end, divided by the source's target: all queues that
are served by weight reach time 1 together, when exactly the budget has been served.
The mix is all queued documents sorted by finish time and cut where the running total
reaches the budget. The document that a source is serving at time 1 is cut there, so
each source's words meet its target to within one word.

Prefix sums are taken in two levels (totals by bucket, then within a bucket), with
buckets of the shuffling hash or of virtual time, so that neither a source that holds
most rows nor the global order ever meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, n_words, written

#: Weights by rank of the source in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size): one row a source. Returns these columns, others that
    it has, source_rank, target and budget (of the whole mix).

    The budget, share times all sizes, is dealt by weight; a target stops at most times
    its source's size and the excess goes to the others by weight. That is a water
    level: sources fill up in the order of size / weight, so one sorted pass finds the
    first that doesn't. One row a source meets in one task, not one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank"))).over(everything))
    )
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return filled.withColumn("target", target).drop("w", "cap", "ratio", "all_w", "level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = 4096, all_rows: bool = False, row_col: str | None = None) -> DataFrame:
    """The mix: a row for each time that a document is taken.

    Returns doc_id, source, size (words), source_size, target, pass (0 for the first
    time), words (taken this time; under size where the target cuts the document),
    finish (virtual time) and position (words of the mix before it); with all_rows
    also rows of no words, so that each document has its pass 0. _queue, _bucket and _row
    identify the input row; _id is its row_col, if one is named.

    Null text: size 0. Null source: a source of its own, last in order. Repeated ids or
    rows: rows of their own; ties in the hash fall back on size and that hash, and what
    is left after that is equal. Empty table or no words: no rows are taken, targets
    are 0. Other columns are dropped, so that clashing names don't matter.
    """
    # By id and text, so that rows that share an id, or have none, are dealt over all buckets.
    parts = F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    key = F.md5(F.concat_ws(":", *parts).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).cast("long").alias("size"), key.alias("_key"), F.xxhash64(id_col, source_col, text_col).alias("_sum"), (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("_id"))
    rows = rows.withColumn("_bucket", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    rows = written(rows.withColumn("_queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-rows")

    per_bucket = rows.groupBy("_queue", "source", "_bucket").agg(F.sum("size").alias("_words"))
    targets = source_targets(per_bucket.groupBy("_queue", "source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("_queue").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).drop("source", "_words")
    starts = written(starts.join(targets.drop("source"), "_queue"), "mix-starts")

    # A bucket of a source: its order, then its place behind the source's earlier buckets.
    own = Window.partitionBy("_queue", "_bucket").orderBy("_key", "size", "_sum")
    queued = rows.withColumn("_row", F.row_number().over(own)).withColumn("_to", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # Both sides are dealt by queue and bucket already; the starts grow with the sources, so they aren't broadcast.
    queued = queued.join(starts.hint("merge"), ["_queue", "_bucket"])
    begin = F.col("_ahead") + F.col("_to") - F.col("size") + F.col("pass") * F.col("source_size")
    passes = F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))
    entries = (
        queued.withColumn("pass", F.explode(passes))
        .withColumn("_begin", begin)
        .withColumn("words", F.least("size", F.greatest(F.lit(0).cast("long"), F.floor("target") - F.col("_begin"))))
        .where((F.col("words") > 0) | F.lit(all_rows) & (F.col("pass") == 0))
        .withColumn("finish", F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("_begin") + F.col("words")) / F.col("target"))).otherwise(F.lit(1.0)))
        .withColumn("_slot", F.floor(F.col("finish") * buckets))
    )
    entries = written(entries.drop("_ahead", "_to", "_key", "_sum"), "mix-entries")
    forget(rows, starts)

    # Global order by virtual time: all queues are served evenly, so its slots are even.
    # Rows of no words all finish at 1 and don't move the total: they keep out of the order.
    some = entries.where("words > 0")
    slots = some.groupBy("_slot").agg(F.sum("words").alias("_words"))
    slots = slots.select("_slot", F.coalesce(F.sum("_words").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_slot").orderBy("finish", "source_rank", "_begin", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = some.withColumn("_run", F.sum("words").over(order)).join(F.broadcast(slots), "_slot")  # buckets + 1 rows at most
    placed = placed.withColumn("position", F.col("_before") + F.col("_run") - F.col("words"))
    placed = placed.withColumn("words", F.least("words", F.greatest(F.lit(0).cast("long"), F.floor("budget") - F.col("position")))).where("words > 0")
    columns = ["doc_id", "source", "size", "source_size", "target", "pass", "words", "finish", "position", "_queue", "_bucket", "_row", "_id"]
    if all_rows:
        none = entries.where("words = 0").withColumn("position", F.lit(None).cast("long"))
        return placed.select(columns).unionByName(none.select(columns))
    return placed.select(columns)


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its words-th word, its white space as it was."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (words + lead).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def taken_by_document(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    got = mix(docs, all_rows=True, **options)
    return got.groupBy("_queue", "_bucket", "_row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of docs, a row for each time that a document is
    taken, in the order of the mix; a document that the target cuts keeps its first words.
    Nulls, ties and repeated rows as in mix; other columns may have any names."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*docs.columns).alias("row")), "mix-documents")
    got = mix(numbered.select("row_id", "row.doc_id", "row.source", "row.text"), row_col="row_id", **options).select(F.col("_id").alias("row_id"), "size", "words", "position")
    # Row numbers are unique, so that copies of a row don't meet each other here.
    rows = numbered.join(got, "row_id")
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    return rows.withColumn("row", F.col("row").withField("text", text)).orderBy("position").select("row.*")
