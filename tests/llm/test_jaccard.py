"""The Jaccard join against all pairs."""

import random

import pytest

from quillstack.llm import jaccard


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def corpus(seed, families=12, size=14):
    rnd = random.Random(seed)
    words = ["w" + str(i) for i in range(30)]
    rows = []
    for _ in range(families):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randint(1, size)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), rnd.choice([" ", "\n", "\t "]).join(text[: rnd.choice([len(text), len(text), max(1, len(text) - 4)])])))
    return rows


@pytest.mark.parametrize(("k", "percent", "block", "bits"), [(3, 90, 128, 20), (5, 80, 2, 10), (2, 50, 3, 8), (3, 70, 1, 12)])
def test_matches_brute_force(spark, k, percent, block, bits):
    rows = corpus(k * percent)
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, "Two Words"), (9004, "two\twords"), (rows[0][0], rows[0][1]), (rows[1][0], "another text of this id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(4)
    got = jaccard.similar_documents(df, k=k, percent=percent, block=block, sketch_bits=bits).collect()
    want = brute(rows, k, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    counts = {(r.doc_id, r.n_shingles) for r in got}
    assert (9000, 0) in counts and (9003, 1) in counts


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_documents(df, k=3, percent=90).collect()}
    assert got == {(None, None), (1, 1)}
    assert jaccard.similar_documents(df.where("false")).count() == 0


def test_one_of_each(spark):
    long, other = "a b c d e f g h", "quite another text under the same id as this"
    rows = [(3, long), (1, "A b c d e f g h"), (2, "z y x"), (2, "z y x"), (5, None), (6, ""), (6, ""), (None, "q r s"), (None, "q r s"), (None, "t u v"), (3, other), (9, other), (9, long), (None, long)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, __n int, key int")
    got = jaccard.one_of_each(df.repartition(3))
    assert got.columns == df.columns and {(r["__n"], r.key) for r in got.collect()} == {(7, 8)}
    want = [(0, "q r s"), (0, "t u v"), (1, "A b c d e f g h"), (2, "z y x"), (3, other), (5, ""), (6, ""), (6, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == want
    assert jaccard.one_of_each(df.where("false")).count() == 0


def test_long_repetitive_words_differ(spark):
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(df, k=3, percent=90).collect()} == {1: 1, 2: 2, 3: 1}
