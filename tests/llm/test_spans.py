"""Substring dedup against a plain pass over all spans."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import spans


def plain_units(text):
    """(start, end, sentence) of each unit: sentences, those of over REACH words cut word by word."""
    out = []
    for number, (a, b) in enumerate(spans.sentences(text)):
        words = [m.span() for m in re.finditer(r"\S+", text[a:b])]
        codes = [np.frombuffer(text[a + i : a + j].lower().encode("utf-32-le"), np.uint32) for i, j in words]
        hashes = [spans.span_hashes(c, np.array([0]), np.array([len(c)])) for c in codes]
        pairs = [int(spans.mixed(x * spans._BASE + y)[0]) for x, y in zip(hashes, hashes[1:], strict=False)]
        cuts = {0}
        for k in range(len(pairs) - spans.REACH + 1):
            window = pairs[k : k + spans.REACH]
            cuts.add(words[k + max(i for i, h in enumerate(window) if h == min(window)) + 1][0])
        edges = [*sorted(cuts), b - a]
        out += [(a + i, a + j, number) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return out


def brute(docs, min_sentences, min_words):
    """Removes, for each span in order of (doc, place), all but the first of its text."""
    seen, gone = {}, {}
    for doc, text in sorted(docs):
        parts = [text[a:b].split() for a, b, _ in plain_units(text)]
        n = len(parts)
        runs = set()
        for i in range(n):
            for j in range(i + min_sentences, n + 1):
                if sum(map(len, parts[i:j])) >= min_words:
                    runs.add((i, j))
                    break
        for j in range(n, 0, -1):
            for i in range(j - min_sentences, -1, -1):
                if sum(map(len, parts[i:j])) >= min_words:
                    runs.add((i, j))
                    break
        for i, j in sorted(runs):
            key = tuple(" ".join(p).lower() for p in parts[i:j])
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone.setdefault(doc, set()).update(range(i, j))
    out = {}
    for doc, text in docs:
        places, g = plain_units(text), gone.get(doc, set())
        kept = "".join(text[a:b] for k, (a, b, _) in enumerate(places) if k not in g)
        out[doc] = (kept.rstrip() if places and len(places) - 1 in g else kept, len({places[k][2] for k in g}))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice(["the", "of", "and", "Ing", "tion", "éla"]) for _ in range(rnd.randint(1, 9))) + rnd.choice([".", "!", "?"]) for _ in range(40)]
    return [(i, rnd.choice([" ", "\n"]).join(rnd.choice(pool[: 4 + i % 37]) for _ in range(rnd.randint(0, 30)))) for i in range(n)]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), min_words=12).collect()}
        assert got == brute(docs, 2, 12)


def test_edges(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. A b c d e f g h i j k."
    rows = [(1, passage, "x", 1), (2, "Own start here now. " + passage + " Own end.", "x", 2), (3, None, "x", 3), (4, "", "x", 4), (None, passage, "y", 5), (5, "clean  text.\n\n Untouched ", "x", 6), (1, passage, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, _from int")
    got = spans.remove_repeats(df).collect()
    assert len(got) == 7 and sorted(r._from for r in got) == [1, 1, 2, 3, 4, 5, 6]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text == passage and by[2][0].text == "Own start here now. Own end." and by[2][0].n_removed == 3
    assert [r.text for r in by[1]] == ["", ""] and by[3][0].text is None and by[4][0].text == "" and by[5][0].text == "clean  text.\n\n Untouched "
    assert spans.remove_repeats(df.where("false")).count() == 0


def test_repeated_rows_keep_their_text(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. A b c d e f g h i j k."
    rows = [(1, passage), (1, passage), (1, passage + " Own end."), (2, "Own start here now. " + passage)]
    for n in (1, 4):  # in one task and in several
        got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) in ([(1, 0), (1, 0), (1, 3), (2, 3)], [(1, 0), (1, 3), (1, 3), (2, 3)])
        assert any(passage in r.text for r in got)
    alone = spark.createDataFrame(rows[:2] * 2 + rows[3:], "doc_id long, text string")
    for n in (1, 4):
        got = spans.remove_repeats(alone.repartition(n)).collect()
        assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(1, passage, 0)] * 4 + [(2, "Own start here now.", 3)]


def test_names_and_null_ids(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. A b c d e f g h i j k."
    texts = [passage, "Own start here now. " + passage, "Another start of it. " + passage + " Own end.", passage]
    names = ["i", "j", "h", "doc", "has", "sum", "row", "__from", "__to", "__key"]
    df = spark.createDataFrame([(None, t, *[k] * len(names)) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for n in (1, 3):
        got = spans.remove_repeats(df.repartition(n)).collect()
        assert len(got) == 4 and all(len({r[x] for x in names}) == 1 for r in got)
        # Of three texts one keeps the passage (two rows, if it is the repeated one).
        assert sum(passage in r.text for r in got) == (2 if passage in {r.text for r in got} else 1)
        assert {r.text.replace(passage, "").split(" ")[0] for r in got} == {"", "Own", "Another"}


def test_long_sentences(spark):
    rnd = random.Random(3)

    def words(n):
        return " ".join("".join(rnd.choice("abcdeÉ") for _ in range(5)) for _ in range(n))

    whole, inner, behind = words(60), words(60), words(30) + ". " + words(30) + "."
    rows = [(1, whole), (2, whole.upper()), (3, f"{words(30)} {inner} {words(30)}"), (4, f"{words(40)} {inner} {words(9)}. Own end."), (5, behind), (6, f"{words(15)} {behind}")]
    rows += [(7, "Short one here. " + words(20) + ". Own."), (8, words(300))]
    by = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k in (1, 3, 5, 7, 8):
        assert by[k].text == dict(rows)[k] and by[k].n_removed == 0
    assert by[2].text == "" and by[2].n_removed == 1 and by[2].words_removed == 60
    own = rows[3][1].replace(inner, "").split()
    left = by[4].text.split()
    assert by[4].words_removed >= 60 - 2 * spans.REACH and by[4].n_removed == 1
    assert [w for w in left if w not in inner.split()] == own
    assert by[6].words_removed >= 60 - spans.REACH and by[6].n_removed == 2 and by[6].text.startswith(rows[5][1][:80])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB .\n\té\u2003İ", max_size=200))
def test_units_cover_the_text_and_are_short(text):
    places, owner = spans.units(text)
    assert "".join(text[a:b] for a, b in places) == text and all(len(text[a:b].split()) <= spans.REACH for a, b in places)
    assert len(owner) == len(places) and {a for a, _ in spans.sentences(text)} <= {a for a, _ in places}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abA B\n.", max_size=300))
def test_units_are_the_plain_ones(text):
    places, owner = spans.units(text)
    assert [(a, b, n) for (a, b), n in zip(places, owner.tolist(), strict=True)] == plain_units(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n\té", max_size=80))
def test_sentences_cover_the_text(text):
    assert "".join(text[a:b] for a, b in spans.sentences(text)) == text
