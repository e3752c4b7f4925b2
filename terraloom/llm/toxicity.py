"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled documents (never from held-out ones): words
and word stems that stand in toxic documents far more often than in clean ones.
Its terms form a trie; the Levenshtein automaton of every term, with a distance
that follows the term's length, is intersected with that trie into one automaton,
made deterministic state by state as words come in.  Most words reach its dead
state within a few letters.  So misspelled terms are caught at the cost of a few
look-ups for a word.

A word runs from letter to letter, with the digits and the signs * @ $ ! # +
inside, so ``id1ot`` and ``st*pid`` are one word each.  How far a misspelling
may go is tested on the labelled sample: a term keeps a distance only if the
words at that distance are no sign of clean documents.

Each hit is weighed by its distance and by its context: inside quotation marks
or near a verb of reporting it counts less, near a second person pronoun more.
The weighed hits of the whole text, and the shares of hits that are quoted,
reported or said to someone, are the features of a logistic regression, fitted
on the same labelled documents.  A quotation ends on its line, however long.

Bounds: ``per_class`` labelled documents of each class (those of smallest id
hash) are used for fitting; that sample bounds the lexicon.  Words are known by
their first 64 letters.  All documents are scored, whole.  Learned things are
small and constant in size, and are sent along with the tasks.

Null texts count as empty; a text without hits gets the score of the intercept.
Without labels of both classes, or with too few toxic ones to pass the evidence
test for any term (about seven), every score is 0.  A null id is never held out.
Repeated rows get equal scores; where an id repeats with different texts, the
smallest of them is learned from.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import table

PER_CLASS, STEM, LEAST_ODDS, EVIDENCE, CUT = 5000, 4, 15.0, 16.0, 0.7
CONTEXT_WORDS = 8
LETTERS = 64
MEMORY, STATES = 100_000, 50_000  # words and states a task remembers before it starts anew; results don't depend on it

WORD = re.compile(r"(?:[$@](?=[^\W\d_]))?[^\W_]+(?:[*@$!#+]+[^\W_]+)*")
QUOTED = re.compile(r"\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|„[^„“\n]+“|‘[^‘’\n]+’|^[ \t]*>[^\n]*", re.M)
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word words term terms slur means sagte schrieb wort begriff dijo escribió palabra término dit écrit mot terme".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes".split())


def allowed(term: str, stem: bool) -> int:
    """Largest edit distance at which a word may count as the term, before it is tested on the sample."""
    n = len(term)
    return int(n >= 5) if stem else 0 if n < 4 else 1 if n < 9 else 2


class Automaton:
    """Deterministic intersection of the terms' Levenshtein automata with their trie."""

    def __init__(self, terms: list[tuple]):
        """``terms``: (term, is a stem) or (term, is a stem, largest distance)."""
        self.terms = [t if len(t) > 2 else (*t, allowed(*t)) for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # the largest distance that any term below allows
        for t, (term, _, k) in enumerate(self.terms):
            node = 0
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append(t)
        self.forget()

    def forget(self) -> None:
        """Back to the start state and the dead one; the others are made again as words come in."""
        self.states: list[tuple[frozenset, tuple[int, int] | None]] = []
        self.number: dict = {}
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple[int, int] | None] = []  # of a word that ends in the state: (distance, term)
        self._state({}, None)  # 0: dead
        self.start = self._state({0: 0}, None)

    def _state(self, places: dict[int, int], stem_hit: tuple[int, int] | None) -> int:
        todo = list(places)
        while todo:  # letters that the word leaves out
            node = todo.pop()
            for child in self.children[node].values():
                d = places[node] + 1
                if d <= self.most[child] and d < places.get(child, 99):
                    places[child] = d
                    todo.append(child)
        whole = stem_hit
        for node, d in places.items():
            for t in self.ends[node]:
                _, stem, most = self.terms[t]
                if d <= most:
                    whole = min(whole or (99, 0), (d, t))
                    if stem:
                        stem_hit = min(stem_hit or (99, 0), (d, t))
        key = (frozenset(places.items()), stem_hit)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.hits.append(whole)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        places: dict[int, int] = {}
        here, stem_hit = self.states[state]
        for node, d in here:
            for letter, child in self.children[node].items():
                e = d + (letter != c)
                if e <= self.most[child]:
                    places[child] = min(e, places.get(child, 99))
            if d + 1 <= self.most[node]:
                places[node] = min(d + 1, places.get(node, 99))
        to = self._state(places, stem_hit)
        if len(self.steps[state]) < 4096:
            self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(distance, term number) of the nearest term, or None."""
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self._step(state, c)
            if not to:
                return None
            state = to
        return self.hits[state]


class Scanner:
    """Turns a text into features with an automaton and a memory of words."""

    def __init__(self, terms: list[tuple]):
        self.automaton = Automaton(terms)
        self.memory: dict[str, tuple[int, int] | None] = {}

    def hits(self, words: list[str]) -> dict[str, tuple[int, int]]:
        memory, out = self.memory, {}
        for w in set(words):
            if w in memory:
                hit = memory[w]
            else:
                if len(memory) >= MEMORY:
                    memory.clear()
                if len(self.automaton.states) >= STATES:
                    self.automaton.forget()
                hit = self.automaton.match(w[:LETTERS])
                if len(w) <= LETTERS:
                    memory[w] = hit
            if hit is not None:
                out[w] = hit
        return out

    def features(self, text: str | None) -> list[float]:
        """log weighed hits, log weighed misspelled hits, any hit, weighed hits for 100 words, shares of quoted, reported and addressed hits."""
        lower = (text or "").lower()
        words = WORD.findall(lower)
        hit = self.hits(words)
        if not hit:
            return [0.0] * 7
        quoted = [(m.start(), m.end()) for m in QUOTED.finditer(lower)]
        exact = fuzzy = in_quotes = reported = addressed = n = 0.0
        q = 0
        for i, m in enumerate(WORD.finditer(lower)):
            found = hit.get(m[0])
            if found is None:
                continue
            while q < len(quoted) and quoted[q][1] <= m.start():
                q += 1
            inside = q < len(quoted) and quoted[q][0] <= m.start()
            window = words[max(0, i - CONTEXT_WORDS) : i + CONTEXT_WORDS + 1]
            weight = 1.0 - 0.7 * inside
            if not REPORTING.isdisjoint(window):
                weight -= 0.2
                reported += 1
            if not SECOND_PERSON.isdisjoint(window):
                weight += 0.2
                addressed += 1
            weight /= 1 + found[0]
            n += 1
            in_quotes += inside
            if found[0]:
                fuzzy += weight
            else:
                exact += weight
        return [math.log1p(exact), math.log1p(fuzzy), min(1.0, exact), (exact + fuzzy) * 100 / len(words), in_quotes / n, reported / n, addressed / n]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """id, text, y of at most ``per_class`` documents of each class, none of them held out."""
    key = labels[id_col].cast("long")
    ok = labels.select(key.alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id")))
    one = ok.groupBy("id").agg(F.max("y").alias("y"))
    here = docs.select(docs[id_col].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    one = one.join(here, "id", "left_semi")
    some = [one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return texts.join(F.broadcast(some[0].union(some[1])), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # at most 2 * per_class ids


def held_out(key):
    """True for a third of the ids: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def learn_terms(train: DataFrame, least_odds: float = LEAST_ODDS, evidence: float = EVIDENCE) -> list[tuple[str, bool, int]]:
    """Words and stems that mark toxic documents: (term, is a stem, largest distance of a misspelling).

    A stem must raise the odds of the toxic class by ``least_odds``, and so many
    of its documents must be toxic that chance would do it with probability
    exp(-``evidence``) at most (Chernoff bound); equal texts count once.  Words
    of fewer than four letters are stems of their own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for w in {w[:LETTERS] for w in WORD.findall((text or "").lower())}:
                    if len(w) > 1:
                        seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64())], ["word", "toxic", "clean"])

    train = train.groupBy("text").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return []
    words = train.select("text", "y").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = sizes[1] / (sizes[0] + sizes[1])
    n, m = F.col("n"), F.col("m")
    odds = (n + 0.5) / (F.greatest(F.lit(0), sizes[1] - n) + 0.5) * (F.greatest(F.lit(0), sizes[0] - m) + 0.5) / (m + 0.5)
    chance = n * F.log(n / (n + m) / share) + F.when(m > 0, m * F.log(m / (n + m) / (1 - share))).otherwise(0.0)
    stems = words.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(F.sum("toxic").alias("n"), F.sum("clean").alias("m"))
    stems = stems.where(n > 0).where((odds >= least_odds) & (chance >= evidence))
    # words of a bounded sample, and of these only those of the stems that passed
    rows = words.withColumn("stem", F.substring("word", 1, STEM)).join(stems.select("stem"), "stem", "left_semi").where("toxic > 0").collect()
    by_stem: dict[str, dict[str, int]] = {}
    for r in sorted(rows, key=lambda r: r["word"]):
        by_stem.setdefault(r["stem"], {})[r["word"]] = r["toxic"]
    terms = []
    for stem, own in sorted(by_stem.items()):
        at, total = stem, sum(own.values())
        while own.get(at, 0) < 0.9 * total:  # go on while one next letter holds nearly all
            following: dict[str, int] = {}
            for w, n in own.items():
                if w.startswith(at) and len(w) > len(at):
                    following[w[: len(at) + 1]] = following.get(w[: len(at) + 1], 0) + n
            best = max(following, key=lambda p: (following[p], p), default=at)
            if following.get(best, 0) < 0.9 * total:
                break
            at = best
        terms.append((at, own.get(at, 0) < 0.9 * total))
    return _tested(train, terms, sizes, least_odds)


def _tested(train: DataFrame, terms: list[tuple[str, bool]], sizes: dict[int, int], least_odds: float) -> list[tuple[str, bool, int]]:
    """The terms with the distances that the sample bears out: words at a distance mustn't stand in clean documents as unlike the term itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for batch in batches:
            seen: dict[tuple[int, int], list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for d, t in set(scanner.hits(WORD.findall((text or "").lower())).values()):
                    seen.setdefault((t, d), [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.int32()) for i in (0, 1)] + [pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1)], ["term", "distance", "clean", "toxic"])

    found = train.select("text", "y").mapInArrow(count, "term int, distance int, clean long, toxic long").groupBy("term", "distance").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()  # three rows a term at most
    counts = {(r["term"], r["distance"]): (r["clean"], r["toxic"]) for r in found}
    out = []
    for t, (term, stem) in enumerate(terms):
        most = 0
        for d in range(1, allowed(term, stem) + 1):
            clean, toxic = counts.get((t, d), (0, 0))
            if clean and (toxic + 0.5) / (sizes[1] + 1) < least_odds * (clean + 0.5) / (sizes[0] + 1):
                break
            most = d
        out.append((term, stem, most))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Terms and weights; small, and the same size whatever the corpus."""

    def __init__(self, terms: list[tuple[str, bool, int]], weights: list[float]):
        self.terms, self.weights = terms, weights

    def scorer(self):
        scanner, weights = Scanner(self.terms), self.weights

        def score(text: str | None) -> float:
            if not weights:
                return 0.0
            z = sum(a * b for a, b in zip(scanner.features(text), weights)) + weights[-1]
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn lexicon and weights from the bounded sample of labelled, not held-out documents."""
    train = training_rows(docs, labels, id_col, text_col, label_col, per_class).persist()
    terms = learn_terms(train)
    if not terms:
        train.unpersist()
        return Model([], [])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scanner.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    rows = train.select("text", "y").mapInArrow(features, "x array<double>, y int").collect()  # at most 2 * per_class short rows
    train.unpersist()
    weights = fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))
    return Model(terms, [float(w) for w in weights])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    key = docs[id_col].cast("long")
    return docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), docs[text_col].alias("text")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, unchanged, all columns in their order; null and empty texts are judged like any."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < CUT for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train_model(docs, table(spark, sf_dir, "labels")))
