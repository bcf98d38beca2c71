"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of binned text features. The weights are learned from
preference pairs (a document labelled good, one labelled bad) by logistic loss on the differences of
their features; the cut between good and bad is a quantile of the strengths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, text_or_empty

#: Labelled rows to learn from at most (a sample by hash, of both labels), and preference pairs.
LABELLED_ROWS, PAIRS = 16_000, 40_000
BINS = 8
#: The score at the cut.
CUT = 0.7

SYMBOLS = re.compile(r"[#$%&*@^~|<>{}\[\]\\=+_]")
DIGITS = re.compile(r"\d")
UPPERS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
ENDS = re.compile(r"[.!?…][\"')\]]*$")

NAMES = ("chars", "words", "word_length", "longest_word", "upper", "digits", "symbols", "periods", "commas", "exclaims", "pipes", "lines", "line_length", "repeated_lines", "unended_lines", "distinct_words", "same_neighbour", "top_word", "second_word", "distinct_pairs", "one_letter", "short_words", "long_words", "capital_words", "inner_symbols", "entropy")


def features(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    top = counts.most_common(2)
    lengths = Counter(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    short = sum(v for k, v in lengths.items() if k <= 3)
    return [
        math.log1p(chars), math.log1p(n), (chars - n) / n, math.log1p(max(lengths)),
        len(UPPERS.findall(text)) / chars, len(DIGITS.findall(text)) / chars, symbols / chars,
        text.count(".") / n, text.count(",") / n, text.count("!") / n, text.count("|") / n,
        len(lines) / n, math.log1p(chars / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(not ENDS.search(x[-8:]) for x in lines) / max(1, len(lines)),
        len(counts) / n ** 0.85, sum(map(str.__eq__, words, words[1:])) / n, top[0][1] / n, top[-1][1] / n, len(set(zip(words, words[1:]))) / n,
        lengths[1] / n, short / n, sum(v for k, v in lengths.items() if k >= 14) / n, sum(map(str.istitle, words)) / n, symbols / n,
        -sum(v / n * math.log(v / n) for v in counts.values()) / math.log(n + 1),
    ]


@dataclass(frozen=True)
class PairwiseRanker:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features * BINS,)
    cut: float
    scale: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Where each feature's bin stands in the weights: (rows, features)."""
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1) + np.arange(len(self.edges)) * BINS

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.cut) * self.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3, steps: int = 300, penalty: float = 1e-3) -> PairwiseRanker:
    """x: (rows, features); y: 0 or 1. With a single label there is nothing to prefer: every document scores on that side of the cut."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((len(NAMES), BINS - 1))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(len(edges) * BINS)
    if not len(good) or not len(bad):
        return PairwiseRanker(edges, weights, 0.0 if len(good) or not len(bad) else 1.0, 1.0)
    # Bad documents are few and extreme; bins at their quantiles too.
    edges = np.sort(np.concatenate([np.quantile(x[good], np.linspace(0, 1, 6)[1:-1], axis=0), np.quantile(x[bad], [0.25, 0.5, 0.75], axis=0)]).T, axis=1)
    model = PairwiseRanker(edges, weights, 0.0, 1.0)
    at = model.bins(x)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        margin = weights[at[a]].sum(1) - weights[at[b]].sum(1)
        pull = 1 / (1 + np.exp(np.clip(margin, -30, 30))) / PAIRS
        grad = penalty * weights / len(weights) ** 0.5
        for f in range(at.shape[1]):
            grad -= np.bincount(at[a, f], pull, len(weights)) - np.bincount(at[b, f], pull, len(weights))
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        weights = weights - 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model = PairwiseRanker(edges, weights, 0.0, 1.0)
    strength = model.strength(x)
    # The quantile of all strengths that tells the labels apart best, both labels weighing the same.
    quantiles = np.quantile(strength, np.linspace(0.002, 0.998, 499))
    gain = [(strength[good] >= q).mean() + (strength[bad] < q).mean() for q in quantiles]
    best = np.flatnonzero(np.isclose(gain, max(gain)))
    cut = float(quantiles[best].mean())
    return PairwiseRanker(edges, weights, cut, 1.0 / max(1e-6, float(np.std(strength))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["label", "x"])


def bounded_sample(labelled: DataFrame, id_col: str, limit: int) -> DataFrame:
    """All rows when they are `limit` at most, else about so many, chosen by a hash of the id."""
    n = labelled.count()
    if n <= limit:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(n)) < limit)


def sampled_texts(docs: DataFrame, labelled: DataFrame, label_col: str, limit: int) -> DataFrame:
    """doc_id, text, label of the documents with a label of the bounded sample. The sample is sent to the texts, which are not shuffled."""
    known = bounded_sample(labelled.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("label")), "doc_id", limit)
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labelled: DataFrame, label_col: str = "quality", limit: int = LABELLED_ROWS) -> PairwiseRanker:
    """`labelled` has doc_id and the label (null labels don't count); it holds the rows to learn from and no others."""
    rows = sampled_texts(docs, labelled, label_col, limit).select("label", "text").mapInArrow(_features, "label int, x array<double>").toPandas()
    order = np.lexsort(np.array(rows["x"].tolist()).reshape(len(rows), -1).T) if len(rows) else []
    rows = rows.iloc[order]
    return fit(np.array(rows["x"].tolist()).reshape(len(rows), len(NAMES)), rows["label"].to_numpy())


def score(docs: DataFrame, model: PairwiseRanker) -> DataFrame:
    """All columns of `docs` and score, predicted (a null text counts as empty). Columns of these names that `docs` has already are replaced."""
    own = docs.drop("score", "predicted", "__text").withColumn("__text", text_or_empty())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(batch.num_rows, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    kept = own.drop("__text").schema
    return own.mapInArrow(run, kept.add("score", "double").add("predicted", "integer"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir).where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
