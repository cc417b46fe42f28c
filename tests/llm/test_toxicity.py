"""The grammar on clauses, and held-out accuracy on labels of invented cues."""

import random
import zlib
from itertools import product

import numpy as np

from quillstack.llm import toxicity as tox


def score(clause, cues):
    classes = tox.Classes(cues)
    found = [classes[w] for w in clause.split()]
    return tox.Composition(tox.GRAMMAR).best([k for k, _ in found], [w for _, w in found])[0]


def test_clauses():
    cues = {"grob": 4.0, "vex*": 5.0}
    plain, aimed = score("such a grob thing", cues), score("you are a grob", cues)
    assert 0 < plain < aimed
    assert score("he said you are a grob", cues) < aimed
    assert score("you are not grob", cues) < aimed
    assert score("i will kill you", cues) > score("i will kill time", cues) == 0
    assert score("vexible", {"vexi*": 5.0}) == 5.0 == score("(vexible),", {"vexi*": 5.0})
    assert score("nothing to see", cues) == 0


def paths(kinds, part=0):
    """Everything that a transducer may count over kinds, by walking all its paths."""
    transducer, out = tox.GRAMMAR[part], []
    todo = [(0, 0, ())]
    while todo:
        at, state, counted = todo.pop()
        if at == len(kinds):
            out.append(counted)
            continue
        todo += [(at + 1, n, counted if c is None else (*counted, c)) for n, c in transducer.step(state, kinds[at])]
    return out


def test_best_path_against_all_paths():
    weights = (1.0, 1.3, 0.7, 3.0, -1.5, -1.0)
    whole = tox.Composition(tox.GRAMMAR, weights)
    for kinds in product(range(6), repeat=4):
        got, counted = whole.best(list(kinds), [0.5 if k == tox.INSULT else 0.0 for k in kinds])
        want = sum(max(sum(weights[c] for c in p) for p in paths(kinds, part)) for part in range(len(tox.GRAMMAR))) + 0.5 * kinds.count(tox.INSULT)
        assert abs(got - want) < 1e-9
        assert abs(got - sum(w * c for w, c in zip(weights, counted, strict=True))) < 1e-9


def test_an_insult_has_one_target():
    kinds = [tox.TARGET, tox.INSULT, tox.TARGET]
    one = lambda before, after: tox.Composition(tox.GRAMMAR, (1.0, before, after, 3.0, -1.5, -1.0)).best(kinds, [0.0, 1.0, 0.0])[0]
    assert one(1.0, 0.5) == 2.0 and one(0.5, 1.5) == 2.5 and one(-1.0, -1.0) == 1.0


def test_arc_weights_follow_the_labels():
    rng = np.random.default_rng(2)
    arcs = np.zeros((400, 6))
    arcs[:, tox.CUE] = rng.uniform(1, 5, 400)
    arcs[:, tox.BEFORE] = rng.integers(0, 2, 400)
    y = (arcs[:, tox.CUE] + 2 * arcs[:, tox.BEFORE] + rng.normal(0, 0.7, 400) > 4).astype(float)
    got = tox._fitted_arcs(arcs, y, np.ones(400))
    assert 1.0 < got[tox.BEFORE] <= 3.0 and got[tox.NEGATED] == tox.PRIOR[tox.NEGATED]
    assert tox._fitted_arcs(arcs, np.zeros(400), np.ones(400)) == list(tox.PRIOR)


def corpus(n=600):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["zork", "quimble", "snarf" + rnd.choice(vocabulary), "snarf" + rnd.choice(vocabulary)])
        docs.append((i, " ".join(words) + "."))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (None, "zork you"), (9000, None), (9001, ""), (9002, "")], "doc_id long, text string").repartition(3)
    got = tox.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) + 4
    by = {r.doc_id: r for r in got}
    for i, _ in docs:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == (by[i].score >= 0.5)
    right = [by[i].predicted == (i % 4 == 0) for i, _ in docs if by[i].held_out]
    assert sum(right) >= 0.97 * len(right)
    assert by[None].predicted == 1 and not by[None].held_out
    assert by[9000].score == by[9001].score == by[9002].score < 0.5


def test_repeated_rows_and_long_texts(spark):
    docs, labels = corpus()
    long = " ".join(t for _, t in docs[1:4]) * 400 + " you zork."
    df = spark.createDataFrame([*[(*d, 1) for d in docs], (*docs[4], 2), (7000, long, 3)], "doc_id long, text string, y int").repartition(3)
    got = tox.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    same = [r.score for r in got if r.doc_id == docs[4][0]]
    assert len(got) == len(docs) + 2 and len(same) == 2 and same[0] == same[1] and sum(r.doc_id == 7000 for r in got) == 1


def test_no_labels_and_empty(spark):
    docs, labels = corpus(20)
    df, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.score_documents(df, none).count() == 20
    assert tox.score_documents(df.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
