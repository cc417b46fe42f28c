"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows and clashing names."""

import os

import pytest

import corpus_pipeline as cp

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")

GOOD = "The people of the town went to the river in the morning, and they talked of the weather. Nobody had seen such rain before. "
OTHER = "Quite another story is told by the old men, who sit by the wall and look at the sea for hours. They know every boat by its name. "
JUNK = " ".join(f"{w}{m * 3}" for w in ("thoner", "oueand", "rend", "the", "tion", "esin") for m in "$%&#*")
NAMES = ["row", "is", "key", "n", "id", "text_sum", "s1", "size", "words", "position", "__n", "__dup", "_sum", "bin_id", "i", "j", "has", "sum"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, GOOD, "a"), (1, GOOD, "a"),  # a repeated row
        (2, GOOD + "So it was.", "a"), (3, OTHER, "a"), (3, GOOD.upper(), "b"),  # an id of two texts
        (4, None, "a"), (5, "", "b"), (6, " \n\t", None), (None, OTHER + "All of them.", "b"), (None, None, None), (7, OTHER * 400, None), (8, JUNK, "a"),
    ]
    rows = [(i, t, "en" if i else None, s, len(t) if t is not None else None, *[k] * len(NAMES)) for k, (i, t, s) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


def texts(df):
    return sorted((r.doc_id or -1, r.text or "") for r in df.collect())


def consistent(df, docs):
    """All columns are there, and a row's own."""
    assert df.columns == docs.columns
    assert all(len({r[n] for n in NAMES}) == 1 for r in df.collect())


def test_quality_classifier(spark, docs):
    kept = cp.keep_good(spark, docs, SMALL)
    consistent(kept, docs)
    ids = [r.doc_id for r in kept.collect()]
    assert not {4, 5, 6} & set(ids) and ids.count(1) in (0, 2)
    assert cp.keep_good(spark, docs.where("false"), SMALL).count() == 0


def test_near_copies(spark, docs):
    kept = cp.drop_near_copies(spark, docs, SMALL)
    consistent(kept, docs)
    # GOOD in three forms is one, under the smallest id; OTHER stays, and the one without an id goes to it.
    assert texts(kept) == sorted([(1, GOOD), (3, OTHER), (4, ""), (5, ""), (6, " \n\t"), (-1, ""), (8, JUNK)] + [(7, OTHER * 400)] * (7 in [r.doc_id for r in kept.collect()]))
    assert cp.drop_near_copies(spark, docs.where("false"), SMALL).count() == 0


def test_repeated_spans(spark, docs):
    kept = cp.drop_repeated_spans(spark, docs, SMALL)
    consistent(kept, docs)
    got = texts(kept)
    assert sum(t.startswith("The people") for _, t in got) == 2 and got.count((1, GOOD)) == 2  # both rows of the one document
    assert (2, "So it was.") in got and {(4, ""), (5, ""), (6, " \n\t"), (-1, "")} <= set(got)
    assert sum(OTHER.strip() in t for _, t in got) == 1
    assert cp.drop_repeated_spans(spark, docs.where("false"), SMALL).count() == 0


def test_mix(spark, docs):
    mixed = cp.mix_sources(spark, docs, SMALL)
    consistent(mixed, docs)
    own = texts(docs)
    rows = mixed.collect()
    assert all(r.text.split() and r.n_chars == len(r.text) for r in rows)
    assert all(any(i == (r.doc_id or -1) and t.startswith(r.text) for i, t in own) for r in rows)
    words = lambda s, df: sum(len((r.text or "").split()) for r in df if r.source == s)
    everything = docs.collect()
    for s in ("a", "b", None):
        assert words(s, rows) <= 2 * words(s, everything)
    assert cp.mix_sources(spark, docs.where("false"), SMALL).count() == 0


def test_packing(spark, docs):
    packed = cp.pack_bins(spark, docs, SMALL).collect()
    per = {}
    for r in packed:
        per[r.doc_id or -1] = per.get(r.doc_id or -1, 0) + r.n_words
    want = {}
    for i, t in texts(docs):
        want[i] = want.get(i, 0) + len(t.split())
    assert per == want and all((r.bin_id is None) == (r.n_words == 0) for r in packed)
    assert cp.pack_bins(spark, docs.where("false"), SMALL).count() == 0
