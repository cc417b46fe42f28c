"""The mix: targets by hand, words by source, determinism."""

import random

import pytest

from quillstack.llm import mixing


def fill(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Deals again and again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = budget - sum(out.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
    return out


def corpus():
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        source = rnd.choice(["a", "a", "a", "b", "É", "z", None, "zz"]) if i % 50 else "tiny"
        rows.append((i, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(0, 60))), source))
    return rows + [(1000, None, "a"), (1001, "\t \n", "b"), (1, rows[1][1], rows[1][2]), (None, "x y z", "b")]


def test_targets_and_words(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int").repartition(5)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = fill(sizes)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    got = mixing.taken_by_document(df).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        _, text, source = by_id[r.doc_id][0]
        assert r.size == len((text or "").split()) and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s, words in taken.items():
        assert want[s] - 1 < words <= want[s]
    again = mixing.taken_by_document(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_positions_and_documents(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus()], "doc_id long, text string, source string, _sum int, _position string").repartition(3)
    rows = sorted(mixing.mix(df).collect(), key=lambda r: r.position)
    at = 0
    for r in rows:
        assert r.position == at and 0 < r.words <= r["size"]
        at += r.words
    assert all(a.finish <= b.finish for a, b in zip(rows, rows[1:], strict=False))
    docs = mixing.mixed_documents(df).collect()
    assert len(docs) == len(rows) and sum(len(d.text.split()) for d in docs) == at
    assert [d.doc_id for d in docs] == [r.doc_id for r in rows]


def test_first_words(spark):
    from pyspark.sql import functions as F

    rows = [("a b\n c  d", 3, "a b\n c"), (" a b", 1, " a"), ("a", 1, "a"), ("a b ", 2, "a b"), ("x y", 0, "")]
    df = spark.createDataFrame(rows, "t string, n int, want string")
    assert all(r.got == r.want for r in df.select("want", mixing.first_words(F.col("t"), F.col("n")).alias("got")).collect())


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.taken_by_document(df).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert mixing.taken_by_document(df.where("false")).count() == 0 and mixing.mix(df).count() == 0
