"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a sequence of token classes: insult, threat, target, negation,
reported speech, other. Small transducers say what they accept by the arcs taken: insults
weigh what the labels say of their cue; an insult may be tied to a target before it, or
wait for one after it; a threat before a target, a negation before an insult and a frame of
reported speech have arcs of their own. They are composed into one machine, whose path
weight is the sum of its arcs' weights, and a clause's score is that of the best path
through it. Arc weights start from fixed values and are fitted to the labels. A document's
score is a logistic function of its matched clauses' scores, of their number and of the
length of the text.

Insult cues (words and word beginnings) are those that labelled toxic texts hold many
times as often, for each word of text, as clean ones. They are taken as a greedy cover:
the cue that most toxic documents hold comes first, and a document that has a few cues
counts no more, until none is worth it. Copies of a document add few cues of their own so.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .learning import fit_logistic, labelled_sample, logits

# Word lists of the grammar, in the four languages of the corpus.
TARGETS = frozenset("you your yours yourself u he him his she her they them their people everyone du dich dir dein ihr euch sie tu toi te vous votre il elle ils elles usted ustedes ti tus ellos ellas".split())
THREATS = frozenset("kill hurt destroy beat burn shoot punch stab hang töten schlagen verbrennen erschießen tuer frapper brûler détruire matar golpear quemar destruir".split())
NEGATIONS = frozenset("not no never none neither nor isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say told called quoted quote wrote writes reported claims claimed sagte sagt schrieb nannte zitierte dit disait écrit appelé cité dijo dice escribió llamó citó".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLAUSE = re.compile(r"[.!?;:\n]+")
_EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*#%$&|-"

#: Cues may be whole words or beginnings of these lengths.
PREFIXES = (4, 5, 6, 7, 8)


# What an arc may count.
CUE, BEFORE, AFTER, MENACE, NEGATED, REPORTED = range(6)
#: Weights of these arcs before the labels are seen; a cue's arc weighs the cue's own weight.
PRIOR = (1.0, 1.0, 1.0, 3.0, -1.5, -1.0)


class Transducer:
    """States and arcs (state, class) -> [(next state, what the arc counts, or None)]. State 0
    is the first. A class without an arc keeps the state."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state, kind: int) -> list:
        return self.arcs.get((state, kind), [(state, None)])


def within(opens: int, closes: int, window: int, counts: int) -> Transducer:
    """Counts class `closes` at most `window` tokens after class `opens`."""
    arcs = {}
    for left in range(window + 1):
        for kind in range(6):
            follows = window if kind == opens else max(0, left - 1)
            arcs[left, kind] = [(follows, counts if left and kind == closes else None)]
    return Transducer(arcs)


def attached(window: int) -> Transducer:
    """Ties each insult to one target at most: to one before it, or to one after it. A state
    is how long a target can still be used (above 0) or an insult still waits (below)."""
    arcs = {}
    for state in range(-window, window + 1):
        later = state - 1 if state > 0 else min(0, state + 1)
        for kind in range(6):
            arcs[state, kind] = [(later, None)]
        arcs[state, TARGET] = [(window, None)]
        arcs[state, INSULT] = [(-window, None)]
        if state > 0:
            arcs[state, INSULT] = [(0, BEFORE), (-window, None), (later, None)]
        elif state < 0:
            arcs[state, TARGET] = [(0, AFTER), (window, None)]
    return Transducer(arcs)


GRAMMAR = (attached(5), within(THREAT, TARGET, 3, MENACE), within(NEGATION, INSULT, 2, NEGATED), within(REPORT, INSULT, 6, REPORTED))


class Composition:
    """The product of transducers under arc weights, with states and arcs made as they are met."""

    def __init__(self, parts, weights=PRIOR):
        self.parts, self.weights = parts, tuple(weights)
        self.start = (0,) * len(parts)
        self.known: dict = {}

    def step(self, states: tuple, kind: int) -> list:
        """(next states, weight, what is counted) of each way on."""
        key = states, kind
        if key not in self.known:
            paths = [((), ())]
            for part, state in zip(self.parts, states, strict=True):
                paths = [((*s, n), c if counts is None else (*c, counts)) for s, c in paths for n, counts in part.step(state, kind)]
            self.known[key] = [(s, sum(self.weights[k] for k in c), c) for s, c in paths]
        return self.known[key]

    def best(self, kinds: list[int], cues: list[float]) -> tuple[float, list[float]]:
        """Weight of the best path over a clause, and how much each arc counts on it. Of equals the first."""
        now = {self.start: (0.0, ())}
        for kind, own in zip(kinds, cues, strict=True):
            following: dict = {}
            for states, (total, path) in now.items():
                for nxt, w, c in self.step(states, kind):
                    value = total + w + own * self.weights[CUE]
                    if nxt not in following or value > following[nxt][0]:
                        following[nxt] = value, path + c if c else path
            now = following
        value, path = max(now.values(), key=lambda x: x[0])
        counted = [0.0] * len(self.weights)
        counted[CUE] = float(sum(cues))
        for k in path:
            counted[k] += 1
        return value, counted


class Classes(dict):
    """(class, cue weight) of a lower-cased word with its punctuation; forgets when it has grown large."""

    def __init__(self, cues: dict[str, float]):
        super().__init__()
        self.cues = cues

    def __missing__(self, word: str) -> tuple[int, float] | None:
        if len(self) > 500_000:
            self.clear()
        w = word.strip(_EDGES)
        weight = max((self.cues[c] for c in cues_of(w) if c in self.cues), default=0.0)
        kind = INSULT if weight else THREAT if w in THREATS else TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else OTHER
        self[word] = out = (kind, weight)
        return out


def cues_of(word: str) -> list[str]:
    """The cues that a word matches: itself, and its beginnings marked by *."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


FEATURES = 7


def clause_features(text: str | None, classes: Classes, grammar: Composition) -> tuple[list[float], list[float]]:
    """Of a text: best clause score, and logarithms of the sum of scores, of the matched
    clauses, of the cues, and of the words; the shares of matched clauses and of cues. Then
    what the arcs count in its matched clauses, for each of these."""
    lowered = (text or "").lower()
    words = lowered.split()
    length = float(np.log1p(len(words)))
    if not any(classes[w][0] in (INSULT, THREAT) for w in words):
        return [0.0, 0.0, 0.0, 0.0, length, 0.0, 0.0], [0.0] * len(PRIOR)
    scores, clauses, cues, arcs = [], 0, 0, np.zeros(len(PRIOR))
    for clause in _CLAUSE.split(lowered):
        found = [classes[w] for w in clause.split()]
        clauses += bool(found)
        if any(k in (INSULT, THREAT) for k, _ in found):
            score, counted = grammar.best([k for k, _ in found], [w for _, w in found])
            arcs += counted
            cues += sum(k == INSULT for k, _ in found)
            scores.append(max(score, 0.0))
    n = len(scores)
    return [max(scores), float(np.log1p(sum(scores))), float(np.log1p(n)), float(np.log1p(cues)), length, n / clauses, float(np.log1p(100 * cues / len(words)))], (arcs / n).tolist()


def _cover(toxic: list[list[str]], weight: dict[str, float], most: int, least: int, deep: int) -> dict[str, float]:
    """Cues for the toxic documents, given by the candidates that they hold: at each step the
    one that most documents hold that have fewer than `deep` cues yet, ties by weight; a word
    before its beginnings."""
    holders: dict[str, set[int]] = {}
    for k, cues in enumerate(toxic):
        for c in cues:
            holders.setdefault(c, set()).add(k)
    out: dict[str, float] = {}
    gain = {c: len(h) for c, h in holders.items() if len(h) >= least}
    left = dict.fromkeys(range(len(toxic)), deep)
    while left and len(out) < most:
        best = max(gain, key=lambda c: (gain[c], weight[c], "*" not in c, c), default=None)
        if best is None or gain[best] < least:
            break
        out[best] = weight[best]
        stem = best.rstrip("*")
        for c in [c for c in gain if c == best or c != stem and c.rstrip("*") != stem and (stem.startswith(c.rstrip("*")) or "*" in best and c.startswith(stem))]:
            del gain[c]  # and cues that say the same less well: shorter beginnings, and what begins with it
        for k in holders[best] & left.keys():
            left[k] -= 1
            if not left[k]:
                del left[k]
                for c in toxic[k]:
                    if c in gain:
                        gain[c] -= 1
    return out


def _fitted_arcs(arcs: np.ndarray, y: np.ndarray, row_weights: np.ndarray, support: int = 20) -> list[float]:
    """Arc weights in units of the cue's, from labelled texts that have matched clauses; arcs
    that fewer than `support` of these take, and all if cues say nothing, keep their prior."""
    some = arcs.any(axis=1)
    out = list(PRIOR)
    if not 0 < y[some].sum() < some.sum():
        return out
    _, scale, b = fit_logistic(arcs[some], y[some], row_weights[some])
    own = b[:-1] / scale
    if own[CUE] <= 0:
        return out
    for k in range(1, len(out)):
        if np.count_nonzero(arcs[:, k]) >= support:
            out[k] = float(np.clip(own[k] / own[CUE], -3.0, 3.0))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 5_000, most_cues: int = 2_000, candidates: int = 20_000, ratio: float = 20.0, least: int = 3, deep: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text. Returns doc_id, held_out, score and predicted.

    Labels are learned from rows whose crc32(doc_id as text) mod 5 isn't 0, at most
    `most` of each value: this bounds what training reads. Candidates for cues are words
    and beginnings that `least` toxic texts hold and that are `ratio` times as frequent in
    toxic texts as in clean ones; the driver holds `candidates` of them at most, those that
    most texts hold, and for each toxic text of the sample which of them it has.
    Only texts are inputs of a score.
    Null or empty text: no clause matches, the score of clean texts. Null ids: not held
    out. No labels: the score is 0.5's constant and nothing is learned. Repeated rows:
    rows of their own. Very long texts: whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    sample, stands_for = labelled_sample(docs, labels.select("doc_id", label), label, most, fold(F.col("doc_id")) != 0)
    sample = written(sample, "toxicity-sample")

    def counted(batches):
        """For each part: cues with the texts that hold them and how often, of toxic and of clean texts; words under a null cue."""
        for batch in batches:
            held: dict = {}
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = Counter((text.as_py() or "").lower().split())
                own: Counter = Counter()
                for w, n in words.items():
                    for c in cues_of(w.strip(_EDGES)):
                        own[c] += n
                held[None, y] = (held.get((None, y), (0, 0))[0] + 1, held.get((None, y), (0, 0))[1] + sum(words.values()))
                for c, n in own.items():
                    texts, times = held.get((c, y), (0, 0))
                    held[c, y] = texts + 1, times + n
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.string()), pa.array([y for _, y in held], pa.int32()), pa.array([t for t, _ in held.values()], pa.int64()), pa.array([n for _, n in held.values()], pa.int64())], ["cue", "y", "texts", "times"])

    parts = written(sample.select("text", "y").mapInArrow(counted, "cue string, y int, texts long, times long"), "toxicity-cues")
    of = lambda y, c: F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0))
    words = {r["y"]: r["n"] for r in parts.where("cue IS NULL").groupBy("y").agg(F.sum("times").alias("n")).collect()}
    rates = parts.where("cue IS NOT NULL").groupBy("cue").agg(of(1, "texts").alias("texts"), of(1, "times").alias("toxic"), of(0, "times").alias("clean"))
    odds = (F.col("toxic") + 0.5) / float(words.get(1, 0) + 1) / ((F.col("clean") + 0.5) / float(words.get(0, 0) + 1))
    rates = rates.where(F.col("texts") >= least).withColumn("weight", F.log(odds)).where(odds >= ratio)
    weight = {r["cue"]: r["weight"] for r in rates.orderBy(F.desc("texts"), F.desc("weight"), "cue").limit(candidates).collect()}
    known = spark.sparkContext.broadcast(weight)

    def holding(batches):
        """The candidates that each toxic text has."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted({c for w in set((t.as_py() or "").lower().split()) for c in cues_of(w.strip(_EDGES)) if c in known.value}) for t in batch.column(0)], pa.list_(pa.string()))], ["cues"])

    # Each text once: copies hold no more than the text does.
    toxic = [r["cues"] for r in sample.where("y = 1").select("text").distinct().mapInArrow(holding, "cues array<string>").collect()]
    lexicon = spark.sparkContext.broadcast(_cover(sorted(toxic), weight, most_cues, least, deep))

    def features(weights):
        def run(batches):
            classes, grammar = Classes(lexicon.value), Composition(GRAMMAR, weights)
            for batch in batches:
                rows = [clause_features(t.as_py(), classes, grammar) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in rows], pa.list_(pa.float64())), pa.array([a for _, a in rows], pa.list_(pa.float64()))], ["y", "x", "arcs"])

        rows = sample.select("y", "text").mapInArrow(run, "y int, x array<double>, arcs array<double>").collect()
        y = np.array([r["y"] for r in rows], float)
        x, arcs = (np.array([r[c] for r in rows], float).reshape(-1, n) for c, n in (("x", FEATURES), ("arcs", len(PRIOR))))
        order = np.lexsort((*x.T, *arcs.T, y))  # the same sums whatever order the rows came in
        return x[order], arcs[order], y[order]

    def stands(y):
        return np.array([stands_for.get(int(v), 1.0) for v in y])

    _, arcs, y = features(PRIOR)
    arc_weights = _fitted_arcs(arcs, y, stands(y))
    x, _, y = features(arc_weights)
    model = spark.sparkContext.broadcast(fit_logistic(x, y, stands(y), ridge=0.1))

    def score(batches):
        classes, grammar = Classes(lexicon.value), Composition(GRAMMAR, arc_weights)
        for batch in batches:
            x = np.array([clause_features(t.as_py(), classes, grammar)[0] for t in batch.column(1)], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-logits(model.value, x))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
