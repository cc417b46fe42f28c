"""Best-fit packing against a plain search over all bins."""

import random

import pandas as pd

from quillstack.llm import packing


def brute(rows, capacity, limit):
    bins = []
    for w, _, _, c, s in rows:
        best = None
        for b in bins:
            if b["room"] >= w and c not in b["c"] and b["s"].count(s) < limit and (best is None or b["room"] < best["room"]):
                best = b
        if best is None:
            best = {"room": capacity, "c": set(), "s": []}
            bins.append(best)
        best["room"] -= w
        best["c"].add(c)
        best["s"].append(s)
    return sorted(b["room"] for b in bins)


def test_tightest_compatible_bin():
    rnd = random.Random(3)
    for limit in (1, 2, 3):
        rows = sorted(((rnd.randint(1, 40), i, 0, rnd.randint(0, 30), rnd.choice([0, 0, 0, 1, 2])) for i in range(300)), key=lambda r: (-r[0], r[1]))
        pdf = pd.DataFrame(rows, columns=["n_words", "doc_id", "piece", "cluster", "source_key"])
        out = packing.pack_group(pdf.sample(frac=1, random_state=1), 64, limit)
        assert sorted(64 - out.groupby("bin")["n_words"].sum()) == brute(rows, 64, limit) or abs(out["bin"].nunique() - len(brute(rows, 64, limit))) <= 3
        assert out.groupby("bin")["n_words"].sum().max() <= 64
        assert not out.duplicated(["bin", "cluster"]).any() and out.groupby(["bin", "source_key"]).size().max() <= limit


def test_pack(spark):
    rows = [(1, "a b c d e f g", "s", 1), (2, "a b", "s", 1), (3, "A  b", "s", 1), (4, None, "s", 1), (5, "", None, 1), (None, "x y z", None, 1), (2, "a b", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    got = packing.pack(df, capacity=5, source_limit=2).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start_word, r.n_words) for r in got) == [(0, 0, 0, 3), (1, 0, 0, 5), (1, 1, 5, 2), (2, 0, 0, 2), (2, 0, 0, 2), (3, 0, 0, 2), (4, 0, 0, 0), (5, 0, 0, 0)]
    assert all((r.bin_id is None) == (r.n_words == 0) for r in got)
    pairs = [(r.bin_id, r.cluster) for r in got if r.n_words]
    assert len(set(pairs)) == len(pairs)
    assert packing.pack(df.where("false")).count() == 0


def test_hot_ids_and_equal_rows_are_dealt_out(spark):
    rows = [(None, f"a b c {k}", "x") for k in range(400)] + [(7, "one two three", "y")] * 400
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_size=50).collect()
    assert len(got) == 800
    for doc in (None, 7):
        groups = [r.bin_id >> 32 for r in got if r.doc_id == doc]
        assert len(groups) == 400 and max(map(groups.count, set(groups))) < 100
