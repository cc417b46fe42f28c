"""Changed lines from unified diffs."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rx


def changed_lines(diffs: DataFrame, diff_col: str = "diff") -> DataFrame:
    """(doc_id, line): the new-side lines that the hunks of each diff name; a pure deletion names the line before it."""
    lines = diffs.select("doc_id", F.explode(F.split(diff_col, "\n")).alias("l")).where(F.col("l").rlike(rx.HUNK))
    start = F.regexp_extract("l", rx.HUNK, 1).cast("int")
    count = F.when(F.regexp_extract("l", rx.HUNK, 2) == "", 1).otherwise(F.regexp_extract("l", rx.HUNK, 2).cast("int"))
    return lines.select("doc_id", F.explode(F.sequence(start, start + F.greatest(count, F.lit(1)) - 1)).alias("line")).distinct()


def git_diff(path: str, ref: str) -> str:
    """The diff of a file against ref; empty where git fails."""
    try:
        return subprocess.run(["git", "diff", "--unified=0", ref, "--", path], capture_output=True, text=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return ""
