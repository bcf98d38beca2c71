"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and a clause is read word by word by five transducers, each fed by the one before
(composition): insult, threat, negation, reported speech and target. Each has a few states of its own, such as how many words a
negation still covers; what an insult becomes depends on them. A bare insult passes at its own weight, an aimed one
at more; one that is denied or reported is told apart and asserts nothing. Where an insult may be aimed at somebody
named only later there are two paths, and the heaviest path through a clause gives its weight. The score grows with
the clauses that assert something; others lift it a little, never to the cut. The insult lexicon
and the weights of the clause features are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, spool, text_or_empty
from .quality import sampled_texts

#: Labelled rows to learn from at most (a sample by hash).
LABELLED_ROWS = 20_000
#: A lexicon word must be in so many toxic texts, be so much likelier there (log odds), and so unlikely to be there by chance (log likelihood ratio; among very many rare words some are).
LEAST_TEXTS, LEAST_WEIGHT, LEAST_EVIDENCE = 4, 2.0, 8.0

# Function words of the grammar in the corpus' four languages.
THREATS = frozenset("kill hurt destroy punch burn beat töten umbringen schlagen vernichten verprügeln tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGETS = frozenset("you your yours u ur they them him her du dich dir ihr euch sie tu te toi vous ton votre ils elles tú usted ustedes vosotros ellos ellas".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't doesn't didn't nobody nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says told claimed called wrote quoted reported sagte sagt schrieb nannte behauptete dit disait écrit affirme appelé dijo dice escribió llamó afirmó".split())

CLAUSES = re.compile(r"[.!?;:\n]+|,\s")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: What comes out: aimed (J), bare (I, H), reported (r) and denied (i) words, with their factors. The last two assert nothing.
FACTORS = {"J": 1.5, "I": 1.0, "H": 0.5, "r": 0.3, "i": 0.2}
ASSERTED = "JIH"
#: Words that a negation covers, and that may lie between an insult and its target.
NEGATION_REACH, TARGET_REACH = 4, 4

Arcs = list[tuple[int, str]]


def insult(state: int, symbol: str) -> Arcs:
    """A word of the lexicon (I) is one; right after another it is part of the same."""
    return [(1 if symbol == "I" else 0, "," if symbol == "I" and state == 1 else symbol)]


def threat(state: int, symbol: str) -> Arcs:
    """A violent word (H) is one; what follows it at once only adds to it."""
    return [(1 if symbol == "H" else 0, "," if symbol == "H" and state == 1 else symbol)]


def negation(state: int, symbol: str) -> Arcs:
    """The state is how many words are still covered; an insult or threat under it is denied."""
    if symbol == "N":
        return [(NEGATION_REACH, symbol)]
    return [(max(0, state - 1), "i" if state and symbol in "IH" else symbol)]


def report(state: int, symbol: str) -> Arcs:
    """From a word of saying on, the rest of the clause is somebody else's."""
    return [(1 if symbol == "R" else state, "r" if state and symbol in "IH" else symbol)]


def target(state: int, symbol: str) -> Arcs:
    """Above 0: somebody was named so many words ago that an insult is aimed. Below 0: an insult waits for somebody to be named in time, or its path ends."""
    if symbol == "Y":
        return [(TARGET_REACH, symbol)]
    if state < 0:
        return [(state + 1, "J" if symbol in "IH" else symbol)] if state < -1 else []
    if symbol in "IH":
        return [(state - 1, "J")] if state else [(0, symbol), (-TARGET_REACH, "J")]
    return [(max(0, state - 1), symbol)]


CASCADE = (insult, threat, negation, report, target)


def composed(states: tuple[int, ...], symbol: str) -> list[tuple[tuple[int, ...], str]]:
    """The arcs of the composition of all transducers from a tuple of their states."""
    found: list[tuple[tuple[int, ...], str]] = [((), symbol)]
    for own, step in zip(states, CASCADE):
        found = [((*before, after), out) for before, mid in found for after, out in step(own, mid)]
    return found


def best_path(symbols: str, weights: list[float]) -> tuple[float, str]:
    """Weight of the heaviest path that ends properly, and what it puts out; at the same weight the path that aims least."""
    paths: dict[tuple[int, ...], tuple[float, str]] = {(0,) * len(CASCADE): (0.0, "")}
    for symbol, weight in zip(symbols, weights):
        ahead: dict[tuple[int, ...], tuple[float, str]] = {}
        for states, (total, told) in paths.items():
            for after, out in composed(states, symbol):
                new = (total + (FACTORS[out] * weight if out in ASSERTED else 0.0), told + out)
                if after not in ahead or new > ahead[after]:
                    ahead[after] = new
        paths = ahead
    return max((p for states, p in paths.items() if states[-1] >= 0), default=(0.0, ""))


@dataclass
class Grammar:
    lexicon: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -3.0

    def __post_init__(self):
        self.known = THREATS | self.lexicon.keys()

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        whole, most, matched, aside = 0.0, 0.0, 0.0, 0.0
        words_all = WORDS.findall(lower)
        n = len(words_all)
        if not self.known.isdisjoint(words_all):  # else no clause has anything to match
            for clause in CLAUSES.split(lower):
                words = WORDS.findall(clause)
                weight = [self.lexicon.get(w) or 1.0 * (w in THREATS) for w in words]
                if not any(weight):
                    continue
                symbols = "".join(
                    ("H" if w in THREATS else "I") if x else "Y" if w in TARGETS else "N" if w in NEGATIONS else "R" if w in REPORTS else "."
                    for w, x in zip(words, weight)
                )
                total, told = best_path(symbols, weight)
                whole, most, matched = whole + total, max(most, total), matched + max([FACTORS[o] for o in told if o in ASSERTED], default=0.0)
                aside += sum(FACTORS[o] * x for o, x in zip(told, weight) if o in "ri")
        size = math.log(math.e + n)
        return [math.log1p(whole), most, math.log1p(whole) / size, matched / (1 + n / 100), math.log1p(matched), aside]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features, the last of which is what is denied or reported: where nothing else is asserted it lifts a score on its way to a bit under the cut."""
        z = x[:, :-1] @ self.weights + self.bias
        z = np.where(np.abs(z) > KNEE, np.sign(z) * (KNEE + np.log1p(np.maximum(np.abs(z) - KNEE, 0))), z)  # so that heavier still scores higher
        s = 1 / (1 + np.exp(-z))
        return s + np.maximum(0, UNASSERTED - s) * (1 - np.exp(-x[:, -1])) / 2


#: Log odds from which on scores are pressed together, and the score that denied and reported words stay under.
KNEE, UNASSERTED = 6.0, 0.4
FEATURES = ("weight", "heaviest_clause", "weight_by_size", "clauses_by_size", "clauses")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, toxic = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set(WORDS.findall(text.lower()))
            word += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """The words that tell enough, as many as the bounded sample has: log odds of a text being toxic, given the word, against the base rate."""
    counts = sample.mapInArrow(_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    n, rate = F.col("t") + F.col("c"), (toxic + 1) / (toxic + clean + 2)
    evidence = F.col("t") * F.log(F.col("t") / n / rate) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - rate))).otherwise(0.0)
    top = (
        counts.where(F.col("t") >= LEAST_TEXTS).withColumn("w", weight)
        .where((F.col("w") >= LEAST_WEIGHT) & (F.col("t") >= 3 * F.col("c")) & (evidence >= LEAST_EVIDENCE))
        .orderBy("word").collect()
    )
    return {r["word"]: r["w"] for r in top}


def fit_weights(grammar: Grammar, x: np.ndarray, y: np.ndarray, steps: int = 400, penalty: float = 1e-3) -> Grammar:
    """Logistic loss over the clause features, both labels weighing the same but for a part of the base rate; no weight falls below 0, so a text never scores less for a heavier clause."""
    if not len(x) or y.min() == y.max():
        grammar.bias = 3.0 if len(y) and y.min() == 1 else -3.0
        return grammar
    scale = np.maximum(x.std(0), 1e-9)
    z = x / scale
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, b = np.zeros(x.shape[1]), -1.0
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        pull = (p - y) * each
        grad = np.r_[pull @ z + penalty * w, pull.sum()]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    grammar.weights, grammar.bias = w / scale, float(b)
    return grammar


def train(docs: DataFrame, labelled: DataFrame, label_col: str = "toxic", limit: int = LABELLED_ROWS) -> Grammar:
    """`labelled` has doc_id and the label (null labels don't count); it holds the rows to learn from and no others.

    One half of the sample gives the lexicon and the other half the weights, and then both halves the
    lexicon: weights learned on the lexicon's own rows would trust it too much.
    """
    rows = spool(sampled_texts(docs, labelled, label_col, limit), "sample")  # read four times
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    counts = {(r["half"], r["label"]): r["count"] for r in rows.groupBy(half.alias("half"), "label").count().collect()}
    first = learn_lexicon(rows.where(half == 0).select("label", "text"), counts.get((0, 1), 0), counts.get((0, 0), 0))
    grammar = Grammar(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([grammar.features(t)[:-1] for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["label", "x"])

    got = rows.where(half == 1).select("label", "text").mapInArrow(run, "label int, x array<double>").toPandas()
    got = got.iloc[np.lexsort(np.array(got["x"].tolist()).reshape(len(got), -1).T)] if len(got) else got
    fitted = fit_weights(grammar, np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)), got["label"].to_numpy())
    whole = learn_lexicon(rows.select("label", "text"), counts.get((0, 1), 0) + counts.get((1, 1), 0), counts.get((0, 0), 0) + counts.get((1, 0), 0))
    return Grammar(whole, fitted.weights, fitted.bias)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns of `docs` but text, and score, predicted.

    A null text counts as empty, which scores as a text without any matched clause; repeated rows score alike;
    very long texts are read whole; an empty table gives an empty one; columns named score or predicted are replaced.
    """
    own = docs.drop("score", "predicted", "__text").withColumn("__text", text_or_empty()).drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(batch.num_rows, len(FEATURES) + 1)
            s = grammar.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    kept = own.drop("__text").schema
    return own.mapInArrow(run, kept.add("score", "double").add("predicted", "integer"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = train(docs, labels(spark, sf_dir).where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), grammar)
