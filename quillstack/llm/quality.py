"""Quality by hierarchical empirical Bayes.

A logistic classifier reads each document. Its evidence is averaged over hosts and over
paths within hosts, and each average is shrunk: a host's to the corpus', a path's to its
host's, by as much as the spread between hosts (or paths) says, estimated by moments, so
that sparse sites say little beyond the prior above them. A document's quality combines
its own evidence with how far its path's posterior lies from the corpus' rate.

Hosts and paths are grouped sums, combined before the shuffle; a host that holds most
rows costs one row for each task.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .learning import fit_logistic, labelled_sample, logits

FEATURES = 12

_CLASS = np.zeros(256, np.int64)  # 1 letters, 2 capitals, 3 digits, 4 white space, 5 usual punctuation, 6 other signs
_CLASS[128:] = 1
for _c, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, [9, 10, 11, 12, 13, 32]), (5, b".,;:'\"()-?"), (6, b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASS[list(_bytes)] = _c


def features_of(text: str | None) -> list[float]:
    """Shares of signs, capitals, repeats and lengths of a text; all of them 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7)
    letters = kinds[1] + kinds[2]
    solid = len(raw) - kinds[4]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        kinds[6] / solid, min(1.0, kinds[6] / n), kinds[5] / solid, kinds[2] / max(1.0, letters), kinds[3] / solid, letters / solid,
        counts[ord("|")] / n, counts[ord("!")] / n, repeated / n, 1 - len(set(lines)) / len(lines), len(set(words)) / n**0.85, min(20.0, solid / n) / 20,
    ]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", most: int = 5_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns for each row of docs: doc_id, host, path, evidence (of the text alone, a
    probability), host_posterior, path_posterior, quality, kept (quality >= threshold) and
    text_sum (a 64-bit hash of the text, to tell rows of one id apart).

    most bounds the labelled rows of each value that the classifier is fitted on.
    Null host or path: a host or path of its own. Null, empty or blank text: no words to
    judge, so quality 0 and not kept. No labels or one value only: the constant of what
    there is. Null ids and repeated rows: rows of their own. Empty table: no rows. Very
    long texts: whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.xxhash64(text_col).alias("text_sum"))
    sample, stands_for = labelled_sample(rows.where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")), labels.select("doc_id", label), label, most)

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["y", "x"])

    got = sample.select("y", "text").mapInArrow(measured, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in got], float)
    x = np.array([r["x"] for r in got], float).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model = spark.sparkContext.broadcast(fit_logistic(x, y, np.array([stands_for.get(int(v), 1.0) for v in y]), ridge=0.1))

    def judge(batches):
        for batch in batches:
            x = np.array([features_of(t.as_py()) for t in batch.column(1)], float).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-logits(model.value, x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.where(x.any(axis=1), p, 0.0))], ["doc_id", "host", "path", "text_sum", "evidence"])

    judged = written(rows.mapInArrow(judge, "doc_id long, host string, path string, text_sum long, evidence double"), "quality-evidence")
    return combine(judged, threshold)


def combine(judged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the posteriors to (doc_id, host, path, evidence) and decides; other columns come last."""
    others = [c for c in judged.columns if c not in ("doc_id", "host", "path", "evidence")]
    p = F.col("evidence")
    paths = written(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "quality-hosts")
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    n, rate = total[0] or 0, (total[1] or 0.0) / max(1, total[0] or 0)
    rate = min(max(rate, 1e-3), 1 - 1e-3)

    def strength(groups: DataFrame) -> float:
        """Prior rows: the variance within groups over the variance between their means."""
        r = groups.agg(F.count("*"), F.sum(F.col("n")), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(rate), 2)), F.sum(F.col("n") * F.col("n"))).first()
        k, rows, inside, between, squares = (float(v or 0) for v in r)
        if k < 2 or rows <= k:
            return 100.0
        within = max(inside / (rows - k), 1e-6)
        spread = (between - (k - 1) * within) / max(rows - squares / rows, 1.0)
        return float(min(max(within / max(spread, 1e-9), 5.0), 1e4))

    of_hosts, of_paths = strength(hosts), strength(paths)
    hosts = hosts.select("host", ((F.col("s") + of_hosts * rate) / (F.col("n") + of_hosts)).alias("host_posterior"))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
    both = written(both.select(F.col("p.host").alias("h"), F.col("path").alias("w"), "host_posterior", ((F.col("s") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths)).alias("path_posterior")), "quality-posteriors")
    out = judged.join(both, judged["host"].eqNullSafe(both["h"]) & judged["path"].eqNullSafe(both["w"]))
    bounded = lambda c: F.least(F.lit(1 - 1e-3), F.greatest(F.lit(1e-3), c))
    own = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("evidence")))
    z = _logit(own) + _logit(bounded(F.col("path_posterior"))) - _logit(F.lit(rate))
    quality = F.when(F.col("evidence") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))
    return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", quality.alias("quality"), (quality >= threshold).alias("kept"), *others)
