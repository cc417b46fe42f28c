"""Substring dedup by sliding sentence spans.

A span is a run of several consecutive sentences: from each sentence on, and up to each
sentence, the shortest run that has at least min_sentences and min_words. Runs in both
directions make the spans of a repeated passage cover it to its last sentence, wherever
the passage starts. A longer repeated run adds nothing to these: at each of its places
but the first, the shortest runs in it are repeats too, and cover it. All spans are hashed
and joined globally; of equal spans the first, by doc_id and place, stays, and the
sentences of the others are removed.

A sentence of more than REACH words is several units, each of which counts as a sentence
in runs: of any REACH neighbouring places between its words, the one with the least hash
of the two words at it is a cut. Cuts depend on the words nearby only, so that a passage
is cut alike wherever it stands, but for its first and last REACH words where the text
around it runs on without a sentence mark.

A task drops its own repeats of a span before the shuffle, so a span that very many
documents share costs one row for each task, and the rows of a span are then read as a
sorted stream, never as a group in memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, written
from .shingles import mixed, small, span_hashes

_END = re.compile(r"(?<=[.!?])[ \t\r\f\v]+|[ \t\r\f\v]*\n\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Spans that a task holds before it sends them on.
HELD = 500_000
#: Words of the longest unit.
REACH = 12
#: White space of str.split().
_WHITE = np.fromiter((chr(c).isspace() for c in range(0x3002)), bool)


def sentences(text: str) -> list[tuple[int, int]]:
    """Start of each sentence and the end of the white space behind it; together they cover the text."""
    cuts = [0, *(m.end() for m in _END.finditer(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def cuts_within(text: str, starts: np.ndarray) -> np.ndarray:
    """Where long sentences, which begin at starts, are cut: places of words, in order."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    b = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], ~_WHITE[np.minimum(b, 0x3001)], [False]))
    first = np.flatnonzero(inside[1:] & ~inside[:-1])
    if len(first) <= REACH:
        return np.empty(0, np.int64)
    words = span_hashes(b, first, np.flatnonzero(inside[:-1] & ~inside[1:]))
    pairs = mixed(words[:-1] * _BASE + words[1:])  # at the place before each word but the first
    owner = np.searchsorted(starts, first, side="right")
    across = np.concatenate(([0], np.cumsum(owner[1:] != owner[:-1])))
    whole = np.flatnonzero(across[REACH:] == across[:-REACH])  # windows in one sentence
    windows = np.lib.stride_tricks.sliding_window_view(pairs, REACH)
    parts = (whole[at : at + HELD // REACH] for at in range(0, len(whole), HELD // REACH))
    least = [p + REACH - windows[p, ::-1].argmin(axis=1) for p in parts]  # the last of equals
    return first[np.unique(np.concatenate(least))] if least else np.empty(0, np.int64)


def units(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Start and end of each unit, which together cover the text, and the number of the sentence that it is in."""
    places = sentences(text)
    starts = np.fromiter((a for a, _ in places), np.int64, len(places))
    more = cuts_within(text, starts)
    if not len(more):
        return places, np.arange(len(places))
    cuts = np.union1d(starts, more)
    both = [*cuts.tolist(), len(text)]
    return list(zip(both[:-1], both[1:], strict=True)), np.searchsorted(starts, cuts, side="right") - 1


def spans_of(text: str, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first unit and end unit (exclusive) of each span."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    parts = [text[a:b].split() for a, b in units(text)[0]]
    n = len(parts)
    if n < min_sentences:
        return none
    words = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    if words[-1] < min_words:
        return none
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(p).lower().encode("utf-8", "surrogatepass")) for p in parts), np.uint64, n)
    powers = np.full(n + 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(n + 1, _INVERSE)
    back[0] = 1
    back = np.cumprod(back)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(mixed(h) * powers[:n])))
    at = np.arange(n + 1)
    ends = np.maximum(np.searchsorted(words, words[:-1] + min_words), at[:-1] + min_sentences)
    forward = np.stack((at[:-1], ends))[:, ends <= n]
    starts = np.minimum(np.searchsorted(words, words[1:] - min_words, side="right") - 1, at[1:] - min_sentences)
    backward = np.stack((starts, at[1:]))[:, starts >= 0]
    i, j = np.unique(np.concatenate((forward, backward), axis=1), axis=1)
    return mixed((prefix[j] - prefix[i]) * back[i] + (j - i).astype(np.uint64)), i, j


def without(text: str, gone: np.ndarray) -> tuple[str, int, int]:
    """The text without the units marked in gone (start, end pairs), the number of sentences that lose words, and the words removed."""
    places, owner = units(text)
    flags = np.zeros(len(places) + 1, np.int64)
    np.add.at(flags, gone[0], 1)
    np.add.at(flags, gone[1], -1)
    flags = np.cumsum(flags)[:-1] > 0
    lost = sum(len(text[a:b].split()) for (a, b), f in zip(places, flags, strict=True) if f)
    kept = "".join(text[a:b] for (a, b), f in zip(places, flags, strict=True) if not f)
    return (kept.rstrip() if flags[-1] else kept), len(np.unique(owner[flags])), lost


def remove_repeats(docs: DataFrame, min_sentences: int = 2, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the text column rewritten, and n_removed (sentences that
    lose words) and words_removed added, in place of columns that have these names.

    Null text: stays null, nothing removed. Texts without a repeated span: unchanged to
    the byte. A text of repeated spans only: empty. Rows with the same id and text are
    one document; rows without an id are told apart by their texts and come first, in the
    order of a hash. Copies of a whole document lose all their spans but those of the
    first. Very long texts: whole. Empty table: no rows. Other columns may have any names.
    """
    # A document: whether it has an id, the id (without one: a second hash of the text), and a hash of the text.
    has, own = F.col(id_col).cast("long").isNotNull().cast("byte"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(29), text_col))
    named = (has.alias("has"), own.alias("doc"), F.xxhash64(text_col).alias("sum"))
    key = docs.select(*named, F.col(text_col).alias("t")).where("t IS NOT NULL")

    def spans(batches):
        rows = ([], [], [], [], [], [])
        held = 0
        for batch in small(batches):
            for known, doc, text_sum, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, i, j = spans_of(text, min_sentences, min_words)
                if not len(h):
                    continue
                for part, x in zip(rows, (h.view(np.int64), np.full(len(h), known), np.full(len(h), doc), np.full(len(h), text_sum), i, j), strict=True):
                    part.append(x)
                held += len(h)
                if held > HELD:
                    yield from firsts(rows)
                    rows, held = ([], [], [], [], [], []), 0
        if held:
            yield from firsts(rows)

    def firsts(rows):
        """One row for each span of this part: the first; a row with no hash for each place that others cover."""
        rows = np.stack([np.concatenate(x) for x in rows])
        rows = rows[:, np.lexsort(rows[::-1])]
        rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]  # rows with the same id and text are one document
        first = np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))
        rest = rows[1:, ~first]
        rest = rest[:, np.lexsort((rest[3], *rest[2::-1]))]
        if rest.shape[1]:  # touching and overlapping places of a document become one
            a, b = rest[3], rest[4]
            of = np.concatenate(([0], np.cumsum((rest[:3, 1:] != rest[:3, :-1]).any(axis=0))))
            wide = int(b.max()) + 2
            top = np.maximum.accumulate(b + of * wide)
            new = np.concatenate(([True], a[1:] + of[1:] * wide > top[:-1]))
            ends = np.concatenate((np.flatnonzero(new)[1:], [len(a)])) - 1
            rest = np.concatenate((rest[:4, new], [(top - of * wide)[ends]]))
        keep, n = rows[:, first], rest.shape[1]
        columns = np.concatenate((keep, np.concatenate((np.zeros((1, n), np.int64), rest))), axis=1)
        mask = np.arange(columns.shape[1]) >= keep.shape[1]
        kinds = (np.int64, np.int8, np.int64, np.int64, np.int32, np.int32)
        arrays = [pa.array(c.astype(k), mask=mask if at == 0 else None) for at, (c, k) in enumerate(zip(columns, kinds, strict=True))]
        yield from pa.table(arrays, ["h", "has", "doc", "sum", "i", "j"]).to_batches(max_chunksize=50_000)

    def later(batches):
        """Of a stream sorted by span and place: all but the first place of each span, which repeated rows share."""
        last = None
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in range(6)])
            new = np.concatenate(([last is None or rows[0, 0] != last[0]], rows[0, 1:] != rows[0, :-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            lead = rows[:, at]
            if last is not None:
                lead[:, at < 0] = last[:, None]
            last = lead[:, -1]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array((rows != lead).any(axis=0))).columns[1:], ["has", "doc", "sum", "i", "j"])

    of = ("has", "doc", "sum")
    found = written(key.mapInArrow(spans, "h long, has byte, doc long, sum long, i int, j int"), "spans-local")
    across = found.where("h IS NOT NULL").repartition("h").sortWithinPartitions("h", *of, "i", "j").mapInArrow(later, "has byte, doc long, sum long, i int, j int")
    places = across.unionByName(found.where("h IS NULL").drop("h"))
    places = written(places.groupBy(*of).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j")), "spans-places")
    forget(found)

    # The input's columns go along as one, so that their names can't clash with these.
    rest = docs.drop("n_removed", "words_removed")
    names = rest.columns
    at = names.index(text_col)
    joined = rest.select(F.struct(*rest.columns).alias("row"), *named).join(places, [*of], "left").select("row", "i", "j")

    def rebuild(batches):
        for batch in small(batches):
            columns = batch.column(0).flatten()
            texts, a, b = columns[at].to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            done = [(t, 0, 0) if not x else without(t, np.array((x, y))) for t, x, y in zip(texts, a, b, strict=True)]
            columns[at] = pa.array([x[0] for x in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], [*names, "n_removed", "words_removed"])

    schema = T.StructType([*rest.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("words_removed", T.LongType())])
    return joined.mapInArrow(rebuild, schema)
