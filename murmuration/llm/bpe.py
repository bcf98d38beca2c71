"""Byte-level BPE encoding and decoding by batched merge rounds.

The distinct words of a batch of texts are encoded together: their symbols lie in one flat array, a
round finds the rank of every adjacent pair by binary search over the sorted pair keys, takes each
word's lowest rank, and merges those pairs in all words at once, until no word has a pair left.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: How byte-level tokenizers of this kind cut a text into words (fixed by the vocabulary file's pre-tokenizer).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that a task remembers, new and recent, at most; and the longest that it remembers.
REMEMBERED, LONGEST = 200_000, 64
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by the usual rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            chars[chr(extra)] = b
            extra += 1
    return chars


class BatchedBpe:
    """Encodes and decodes with one vocabulary file (byte-level BPE in the tokenizers library's JSON format)."""

    def __init__(self, data: dict):
        vocab, alphabet = data["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.width = np.int64(max(self.bytes_of) + 1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.start = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        self.new: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        symbols = self.start[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_word = [], []
        while len(symbols):
            same = word[1:] == word[:-1]
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], NO_RANK)
            first = np.flatnonzero(np.r_[True, ~same])
            padded = np.r_[rank, NO_RANK]
            lowest = np.minimum.reduceat(padded, first)
            counts = np.diff(np.r_[first, len(symbols)])
            # Words in which nothing merges leave the array.
            active = np.repeat(lowest < NO_RANK, counts)
            if not active.all():
                done_ids.append(symbols[~active])
                done_word.append(word[~active])
            hit = (padded == np.repeat(lowest, counts)) & active
            hit = self._leftmost(hit)
            where = np.flatnonzero(hit)
            symbols[where] = self.merged[padded[where]]
            keep = active
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids, of = (np.concatenate(done_ids), np.concatenate(done_word)) if done_ids else (symbols, word)
        order = np.argsort(of, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(of, minlength=len(words)))[:-1])

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of overlapping pairs (aaa), every second one from the left merges."""
        at = np.flatnonzero(hit)
        if len(at) < 2:
            return hit
        run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
        first = at[np.r_[True, np.diff(at) > 1]]
        out = np.zeros_like(hit)
        out[at[(at - first[run]) % 2 == 0]] = True
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """(tokens, their ids in decimal, their bytes) of each word."""
        found = {}
        missing = []
        for w in words:
            x = self.new.get(w) or self.old.get(w)
            if x is None:
                missing.append(w)
            else:
                found[w] = x
        if missing:
            for w, ids in zip(missing, self.encode_words(missing)):
                ids = ids.tolist()
                found[w] = (len(ids), ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids]))
        if len(self.new) > REMEMBERED // 2:
            self.old, self.new = self.new, {}
        self.new.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return found

    def pieces(self, text: str) -> list[str | int]:
        """Words, with special tokens as ids."""
        if self.cut is None or not self.cut.search(text):
            return WORDS.findall(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += WORDS.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of tokens, ids in decimal joined by commas, decoded bytes) of each text."""
        cut = [self.pieces(t) for t in texts]
        known = self.learn({w for pieces in cut for w in pieces if isinstance(w, str)})
        known |= {i: (1, str(i), self.bytes_of[i]) for i in self.special.values()}
        out = []
        for pieces in cut:
            got = [known[p] for p in pieces]
            out.append((sum(x[0] for x in got), ",".join([x[1] for x in got]), b"".join([x[2] for x in got])))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_batch([text])[0][1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode(errors="replace")


@lru_cache(maxsize=2)
def _coder(name: str) -> BatchedBpe:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return BatchedBpe(json.load(f))


#: Texts that a round takes together: fewer when they are long.
ROUND_CHARS = 2_000_000


def _rounds(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= ROUND_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the token ids themselves: one row for each row of `docs`.

    `vocabulary` is the path of the tokenizer's JSON file on the driver; Spark hands it to the
    executors. A null or empty text has no tokens and decodes to an empty text. Other columns are
    not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _rounds(texts):
                got = coder.encode_batch(texts[start:end])
                columns = [
                    batch.column(0).slice(start, end - start),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()),
                    pa.array([hashlib.sha256(_valid(g[2])).hexdigest() for g in got], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([[int(i) for i in g[1].split(",")] if g[1] else [] for g in got], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def _valid(raw: bytes) -> bytes:
    return raw.decode(errors="replace").encode()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), vocabulary_path())
