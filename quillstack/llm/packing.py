"""Best-fit packing under conflicts.

Documents are cut into pieces of at most the capacity and packed, largest first, into
the bin with the least room that still holds the piece and has no conflict with it: no
piece of the same duplicate cluster, and no more than source_limit pieces of the same
source. Bins are kept by residual, with one bit for each residual that some bin has, so
that the tightest bin is a successor search; each bin carries bitmaps of its clusters
and sources, and the search goes on to the next bin until a compatible one is found.

Pieces are dealt by a hash into groups of about group_size, packed on their own, so that
the tightest bin is sought among those of a piece's group; what that costs is the bins that
a group ends with half filled. A hot source or a large cluster spreads over all groups.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, written


class Bins:
    """Bins of one group, ordered by residual."""

    def __init__(self, capacity: int, source_limit: int):
        self.capacity, self.limit = capacity, source_limit
        self.by_residual: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.some = 0  # bit r: a bin has residual r
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # by count: bit s of the k-th, the bin has over k pieces of source s

    def put(self, words: int, cluster: int, source: int) -> int:
        """cluster and source as single bits. Returns the bin."""
        ahead = self.some >> words << words
        while ahead:
            low = ahead & -ahead
            residual = low.bit_length() - 1
            for b in self.by_residual[residual]:
                if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                    self.move(b, residual - words)
                    break
            else:
                ahead ^= low
                continue
            break
        else:
            b = len(self.residual)
            self.residual.append(-1)
            self.clusters.append(0)
            self.sources.append([0] * self.limit)
            self.move(b, self.capacity - words)
        self.clusters[b] |= cluster
        for k, bits in enumerate(self.sources[b]):
            if not bits & source:
                self.sources[b][k] |= source
                break
        return b

    def move(self, b: int, residual: int) -> None:
        old = self.residual[b]
        if old >= 0:
            del self.by_residual[old][b]
            if not self.by_residual[old]:
                self.some ^= 1 << old
        self.residual[b] = residual
        self.by_residual[residual][b] = None
        self.some |= 1 << residual


def pack_group(pdf: pd.DataFrame, capacity: int, source_limit: int) -> pd.DataFrame:
    """Packs the pieces of one group: adds bin (from 0), slot and bin_words."""
    pdf = pdf.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
    bins = Bins(capacity, source_limit)
    clusters, sources = ({k: 1 << i for i, k in enumerate(pdf[c].unique())} for c in ("cluster", "source_key"))
    pdf["bin"] = [bins.put(w, clusters[c], sources[s]) for w, c, s in zip(pdf["n_words"].tolist(), pdf["cluster"], pdf["source_key"], strict=True)]
    pdf["slot"] = pdf.groupby("bin").cumcount()
    pdf["bin_words"] = pdf.groupby("bin")["n_words"].transform("sum")
    return pdf


def pack(docs: DataFrame, capacity: int = 2048, source_limit: int = 3, group_size: int = 16384, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """Packs documents into bins of at most capacity words.

    Returns a row for each piece: doc_id, source, cluster, piece (from 0), start_word,
    n_words, bin_id, slot and bin_words. cluster_col: the duplicate cluster; without it,
    documents with the same words are a cluster.

    Null, empty or blank text: one piece of no words, in no bin (bin_id null). Texts over
    the capacity: whole pieces and a rest; being of one cluster, they get bins of their
    own. Null source: a source of its own. Null ids and repeated rows: rows of their own.
    Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), cluster.alias("cluster"), n_words(text).cast("long").alias("words"), F.monotonically_increasing_id().alias("salt"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / capacity), F.lit(1).cast("long")) - 1)))
    start = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "source", "cluster", "piece", start.alias("start_word"), F.least(F.lit(capacity).cast("long"), F.col("words") - start).alias("n_words"), "salt")
    pieces = written(pieces.withColumn("source_key", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))), "packing-pieces")

    some = pieces.where("n_words > 0")
    groups = max(1, math.ceil(some.count() / group_size))
    some = some.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "salt", F.lit(7)), F.lit(groups)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(pdf, capacity, source_limit)
        out["bin_id"] = out["group"] * (1 << 32) + out["bin"]
        return out[["doc_id", "source", "cluster", "piece", "start_word", "n_words", "bin_id", "slot", "bin_words"]]

    schema = "doc_id long, source string, cluster long, piece long, start_word long, n_words long, bin_id long, slot long, bin_words long"
    none = pieces.where("n_words = 0").select("doc_id", "source", "cluster", "piece", "start_word", "n_words", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "slot", "bin_words")])
    return some.groupBy("group").applyInPandas(packed, schema).unionByName(none)
