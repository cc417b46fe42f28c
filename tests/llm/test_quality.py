"""Hierarchical empirical Bayes: shrinkage by hand, and held-out accuracy."""

import random

import pytest

from quillstack.llm import quality


def test_shrinkage(spark):
    rows = [(i, "big", "en", 0.9 if i % 10 else 0.3) for i in range(1000)] + [(2000 + i, "bad", "en", 0.05) for i in range(200)] + [(3000, "tiny", "en", 0.02), (3001, None, None, 0.9), (3002, "big", "de", 0.6)]
    got = {r.doc_id: r for r in quality.combine(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    rate = sum(r[3] for r in rows) / len(rows)
    assert got[0].host_posterior > rate > got[2000].host_posterior
    assert abs(got[3000].host_posterior - rate) < abs(0.02 - rate)  # one document can't speak for its host
    assert got[2000].quality < 0.05 < got[2000].host_posterior + 0.05
    assert got[3001].kept and len(got) == len(rows)
    assert min(got[0].host_posterior, got[3002].path_posterior) > 0.5


def corpus(n=500):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(4, 80))]
        kind = i % 8
        if kind == 0:
            text = [w + rnd.choice(["%%%", "###", "&&&"]) for w in text]
        elif kind == 1:
            text = text[:1] * len(text)
        docs.append((i, " ".join(text) + ".", f"s{i % 3}", "en"))
        if i % 2 or kind < 2 and i % 3:
            labels.append((i, int(kind > 1)))
    return docs, labels


def test_accuracy_and_edges(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (None, "some text of a few words.", None, None), (9000, None, "s1", "en"), (9001, " \n", "s1", "en")], "doc_id long, text string, source string, lang string").repartition(3)
    got = quality.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs) + 3
    by = {r.doc_id: r for r in got}
    seen = {i for i, _ in labels}
    rest = [by[i].kept == (i % 8 > 1) for i, *_ in docs if i not in seen]
    assert sum(rest) >= 0.95 * len(rest)
    assert not by[9000].kept and by[9001].quality == 0.0 and by[None].host is None
    assert quality.score_documents(df.where("false"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
    assert quality.score_documents(df, spark.createDataFrame([], "doc_id long, quality int")).count() == len(got)


def test_features():
    assert quality.features_of(None) == quality.features_of(" \n") == [0.0] * quality.FEATURES
    assert quality.features_of("a a a a")[8] == pytest.approx(0.75)


def test_features_by_hand():
    rnd = random.Random(9)
    for _ in range(40):
        text = "".join(rnd.choice("aB1 ,|!#\n\té.") for _ in range(rnd.randint(1, 80)))
        raw = text.encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        if not words:
            continue
        solid = sum(c not in b" \n\t" for c in raw)
        odd = sum(c in b"!#|" for c in raw)
        capitals = raw.count(b"B")
        letters = sum(c in b"aB" or c >= 128 for c in raw)
        want = [odd / solid, min(1, odd / len(words)), sum(c in b",." for c in raw) / solid, capitals / max(1, letters), raw.count(b"1") / solid, letters / solid, raw.count(b"|") / len(words), raw.count(b"!") / len(words)]
        # "!" and "|" are odd signs, commas and stops usual ones.
        assert quality.features_of(text)[:8] == pytest.approx(want)
        assert quality.features_of(text)[8:10] == pytest.approx([sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), 1 - len(set(lines)) / len(lines)])


def test_scores_by_hand(spark):
    """The whole score again in plain Python, from the evidence on."""
    import math

    docs, labels = corpus(240)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    got = quality.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()

    def groups(key):
        out = {}
        for r in got:
            out.setdefault(key(r), []).append(r.evidence)
        return out

    hosts, paths = groups(lambda r: r.host), groups(lambda r: (r.host, r.path))
    rate = sum(r.evidence for r in got) / len(got)

    def strength(parts):
        n = sum(map(len, parts))
        if len(parts) < 2 or n <= len(parts):
            return 100.0
        mean = [sum(p) / len(p) for p in parts]
        within = max(sum((x - m) ** 2 for p, m in zip(parts, mean, strict=True) for x in p) / (n - len(parts)), 1e-6)
        between = sum(len(p) * (m - rate) ** 2 for p, m in zip(parts, mean, strict=True))
        spread = (between - (len(parts) - 1) * within) / max(n - sum(len(p) ** 2 for p in parts) / n, 1.0)
        return min(max(within / max(spread, 1e-9), 5.0), 1e4)

    of_hosts, of_paths = strength(list(hosts.values())), strength(list(paths.values()))
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        h = (sum(hosts[r.host]) + of_hosts * rate) / (len(hosts[r.host]) + of_hosts)
        own = paths[r.host, r.path]
        p = (sum(own) + of_paths * h) / (len(own) + of_paths)
        assert r.host_posterior == pytest.approx(h) and r.path_posterior == pytest.approx(p)
        z = logit(min(max(r.evidence, 1e-12), 1 - 1e-12)) + logit(min(max(p, 1e-3), 1 - 1e-3)) - logit(rate)
        assert r.quality == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.kept == (r.quality >= 0.5)


def test_repeated_rows_long_texts_and_names(spark):
    docs, labels = corpus(200)
    rows = [(*d, 1, 2) for d in docs] + [(*docs[3], 1, 2), (700, docs[2][1] * 3000, "s1", "en", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h int, evidence int").repartition(3)
    got = quality.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    twice = [r for r in got if r.doc_id == docs[3][0]]
    assert len(got) == 202 and len(twice) == 2 and twice[0] == twice[1] and sum(r.doc_id == 700 for r in got) == 1
