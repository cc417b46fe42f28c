"""Exact n-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets form a class, joined once through its smallest id.
Similar classes are put into groups: classes that share a rare shingle are compared
with one leader, and those linked to it, directly or through others, are a group. The
matrix is the table of (prefix shingle, group) with group blocks of bounded size. A
class whose prefix meets another group's is a query against that group's blocks; a
block stores the union of its members' shingles, and is opened only if the query shares
enough with that union. Groups are connected already, so the first link found in an
opened block settles the pair of groups, and no group is expanded into pairs.

Prefixes make this exact: two sets with Jaccard t or more share a shingle among the
first n - ceil(t n) + 1 of each in any one order. The order is by a count sketch over
all documents (its size is a parameter), so frequent shingles come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .graph import connected_components
from .shingles import shingle_sets, small

SLICES = 256


def _sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How many documents have a shingle in each of 2**bits hash buckets: 4 * 2**bits bytes, whatever the input."""
    width = max(1, (1 << bits) // SLICES)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        total = total.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(np.arange((1 << bits) // width, dtype=np.int32)), "counts": pa.array([part.tobytes() for part in total.reshape(-1, width)], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())})

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return out


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int = 20, block: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents with 100 * intersection >= percent * union of their shingle sets.

    Returns a row for each input row: doc_id, n_shingles and component_id, the smallest
    doc_id reachable by links.

    Null, empty or blank text: no shingles, linked with nothing. Fewer than k words: one
    shingle of all of them. Null ids: a row with a null component. Rows that share an id
    are one document, linked with whatever either is. Empty table: no rows. Very long
    texts: whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = spark.sparkContext.broadcast(_sketch(docs, k, sketch_bits))
    shift = np.uint64(64 - sketch_bits)

    def describe(batches):
        counts = sketch.value
        for batch in small(batches):
            n, f1, f2, prefixes = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                if not len(s):
                    f1.append(None), f2.append(None), prefixes.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                f1.append(int(digest[0])), f2.append(int(digest[1]))
                order = np.lexsort((s, counts[(s >> shift).astype(np.int64)]))
                prefixes.append(s[order[: len(s) + (-percent * len(s) // 100) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "prefix"])

    described = written(docs.mapInArrow(describe, "doc_id long, n long, f1 long, f2 long, prefix array<long>"), "jaccard-docs")
    sets_of_text = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = sets_of_text.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("r")).select("f1", "f2", F.col("r.doc_id").alias("rep"), "r.n", "r.prefix")
    classes = written(classes, "jaccard-classes")

    # Shingles in two prefixes or more, with the smallest class that has each as its leader.
    tokens = classes.select("rep", F.explode("prefix").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("rep").alias("leader")).where("c > 1").select("token", "leader"), "jaccard-shared")
    met = written(tokens.join(shared, "token"), "jaccard-met")
    lengths = classes.select("rep", "n")

    # Groups: classes linked to the leader of some of their shingles.
    to_leader = met.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("c"))
    to_leader = to_leader.join(lengths, "rep").join(lengths.select(F.col("rep").alias("leader"), F.col("n").alias("m")), "leader")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    to_leader = written(to_leader.where(fits & (F.col("c") >= _least_common(F.col("n"), F.col("m"), percent))).select("rep", "leader"), "jaccard-to-leader")
    sets = written(_sets(docs, to_leader.select(F.col("rep").alias("doc_id")).unionByName(to_leader.select(F.col("leader").alias("doc_id"))).distinct(), k), "jaccard-leader-sets")
    a, b = sets.select(F.col("doc_id").alias("rep"), F.col("tokens").alias("x")), sets.select(F.col("doc_id").alias("leader"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    linked = to_leader.join(a, "rep").join(b, "leader").where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("rep", "leader")
    # An id of several texts ties their classes together.
    of_id = sets_of_text.select("doc_id", "f1", "f2")
    several = of_id.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    tied = of_id.join(several, "doc_id").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("leader"), "rep")
    linked = linked.unionByName(tied)
    grouped = _components(linked, "rep", "leader", "jaccard-groups")
    forget(to_leader, sets, shared)

    crossing = _crossing_links(met.join(lengths, "rep"), grouped, docs, k, percent, block)
    merged = _components(crossing, "a", "b", "jaccard-merged")
    forget(met, crossing)

    group_of = classes.select("f1", "f2", "rep").join(grouped.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    group_of = group_of.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    group_of = written(group_of.select("f1", "f2", F.coalesce("top", "component").alias("component_id")), "jaccard-class-groups")
    out = described.join(group_of, ["f1", "f2"], "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "jaccard-result")
    forget(described, classes, grouped, merged, group_of)
    return out


def _components(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    found = connected_components(links, a, b, name + "-steps")
    out = written(found, name)
    forget(found)
    return out


def _least_common(n, m, percent: int):
    """How many shingles the prefixes of sets of n and m must have in common if the sets
    are to be similar: what lies behind the prefix that ends first can't make up the rest."""
    overlap = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - 1e-6)
    behind = F.ceil(F.lit(percent) * F.greatest(n, m) / F.lit(100) - 1e-6) - 1
    return F.greatest(F.lit(1).cast("long"), overlap - behind)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, tokens: the shingle sets of the documents in ids."""

    def whole(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(batch.column(1), k)], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(whole, "doc_id long, tokens array<long>").where(F.size("tokens") > 0)


def _crossing_links(met: DataFrame, grouped: DataFrame, docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between groups: those of a class against another group's blocks."""
    sizes = written(grouped.groupBy("component").agg(F.count("*").alias("members")), "jaccard-sizes")
    known = written(grouped.join(sizes, "component").select(F.col("node").alias("rep"), "component", "members"), "jaccard-known")
    rows = met.join(known, "rep", "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep")).withColumn("members", F.coalesce("members", F.lit(1).cast("long")))
    every = written(rows, "jaccard-rows")
    several = every.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    several = written(several, "jaccard-several")
    some = written(every.join(several, "token"), "jaccard-crossing-rows")
    forget(every, several, sizes, known)
    rows = some.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / block)))

    # The matrix, and the queries that meet it: the smaller group's classes ask.
    matrix = written(rows.groupBy("token", "component", "members", "block").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi")), "jaccard-matrix")
    asks = rows.select("token", "rep", "n", F.col("component").alias("c"), F.col("members").alias("m"))
    ahead = (F.col("m") < F.col("members")) | ((F.col("m") == F.col("members")) & (F.col("c") > F.col("component")))
    # A block can hold a match only if it shares enough of the prefix, for the most lenient of
    # its lengths: the shortest or the longest, less one for rounding between them.
    shortest = F.greatest("n_lo", F.ceil(F.col("n") * percent / 100 - 1e-6))
    longest = F.least("n_hi", F.floor(F.col("n") * 100 / percent + 1e-6))
    queries = asks.join(matrix, "token").where(ahead).groupBy("rep", "n", F.col("c").alias("own"), "component", "block").agg(F.count("*").alias("common"), F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"))
    queries = queries.where((shortest <= longest) & (F.col("common") >= F.least(_least_common(F.col("n"), shortest, percent), _least_common(F.col("n"), longest, percent)) - 1))
    queries = written(queries.select("rep", "own", "component", "block"), "jaccard-queries")

    # Blocks with very many queries are opened in several places.
    chunks = queries.groupBy("component", "block").agg(F.ceil(F.count("*") / 1024).alias("chunks"))
    chunks = written(chunks, "jaccard-chunks")
    asked = queries.join(chunks, ["component", "block"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    members = rows.select("rep", "component", "block").distinct().join(chunks, ["component", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    both = asked.select("rep", "own", "component", "block", "chunk").unionByName(members.select("rep", F.lit(None).cast("long").alias("own"), "component", "block", "chunk"))
    opened_rows = both = written(both, "jaccard-opened")
    sets = written(_sets(docs, both.select(F.col("rep").alias("doc_id")).distinct(), k), "jaccard-opened-sets")
    both = both.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def opened(pdf):
        import pandas as pd

        inside = pdf[pdf["own"].isna()]
        ids, stored = inside["rep"].to_numpy(), [np.asarray(t) for t in inside["tokens"]]
        union = np.unique(np.concatenate(stored)) if stored else np.empty(0, np.int64)
        found = {}
        for rep, own, tokens in pdf[pdf["own"].notna()][["rep", "own", "tokens"]].itertuples(index=False):
            if int(own) in found or not len(union):
                continue  # the two groups are linked already
            q = np.asarray(tokens)
            least = -(-percent * len(q) // 100)
            at = np.minimum(np.searchsorted(union, q), len(union) - 1)
            if int((union[at] == q).sum()) < least:
                continue
            for other, s in zip(ids, stored, strict=True):
                inter = len(np.intersect1d(q, s, assume_unique=True))
                if inter * 100 >= (len(q) + len(s) - inter) * percent:
                    found[int(own)] = int(pdf["component"].iloc[0])
                    break
        return pd.DataFrame({"a": list(found), "b": list(found.values())}, dtype="int64")

    found = written(both.groupBy("component", "block", "chunk").applyInPandas(opened, "a long, b long"), "jaccard-crossing")
    forget(some, matrix, queries, chunks, opened_rows, sets)
    return found


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each group of similar texts: of the smallest id and, of its texts
    in the group, the first by a hash.

    Documents are told apart by id and text, so that an id of several texts loses none of
    them but to a text that is similar. Rows without an id are compared too, and come
    last in a group. Texts without words all stay. Repeated rows: one stays. Empty table:
    no rows. Very long texts: whole. Other columns may have any names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    solid = rows.where(~blank).select("row", "id", "text", F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(31), "text").alias("s2"))

    # What a document is known by: its id; where that is null or has several texts, a hash of both.
    sums = solid.groupBy("id").agg(*[f(s).alias(f"{f.__name__}_{s}") for f in (F.min, F.max) for s in ("s1", "s2")])
    several = sums.where("id IS NOT NULL AND (min_s1 <> max_s1 OR min_s2 <> max_s2)").select(F.col("id").alias("of_several"))
    several = written(several, "jaccard-several-texts")
    known_by = F.when(F.col("id").isNull() | F.col("of_several").isNotNull(), F.xxhash64("id", "s1", "s2")).otherwise(F.col("id"))
    keyed = solid.join(several, solid["id"] == several["of_several"], "left").select("row", "id", "text", "s1", "s2", known_by.alias("key"))

    found = similar_documents(keyed.select("key", "text"), k=k, percent=percent, id_col="key", **options)
    groups = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    head = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "s1", "s2", "key"))["key"]
    heads = keyed.select("key", "id", "s1", "s2").distinct().join(groups, "key").groupBy("component").agg(head.alias("head"))
    gone = written(groups.join(heads, "component").where("key <> head").select("key"), "jaccard-gone")
    forget(found)

    of_key = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    kept = keyed.join(gone, "key", "left_anti").withColumn("n", F.row_number().over(of_key)).where("n = 1")
    return kept.select("row").unionByName(rows.where(blank).select("row")).select("row.*")
