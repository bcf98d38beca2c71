"""Exact dedup by a Golomb-coded fingerprint exchange.

Each part of the input sorts the short fingerprints of its texts and sends them, Golomb-Rice coded,
to the owners of the fingerprint ranges. An owner merges what it got and answers each part with a
bitmap of the fingerprints that occur elsewhere too. Only texts under such a fingerprint (suspects)
are then shuffled and compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashed_filter, spool, text_or_empty

FINGERPRINT_BITS = 48
#: Rows of a part at most: what a task holds at once in either direction.
PART_ROWS = 100_000
#: Fingerprints of an owner, about.
OWNER_ROWS = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct values as gaps: unary quotients of gap >> k, then the k low bits of each gap."""
    gaps = np.diff(values, prepend=np.int64(0))
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    head = np.packbits(unary).tobytes()
    return len(head).to_bytes(4, "little") + head + np.packbits(low).tobytes()


def golomb_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 4)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + size))[: n * k].reshape(n, k)
    rest = low @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else np.zeros(n, np.int64)
    return np.cumsum((quotient.astype(np.int64) << k) + rest)


def rice_bits(values: np.ndarray) -> int:
    mean = int(values[-1]) // len(values)
    return max(0, mean.bit_length() - 1)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        digests = [hashlib.sha256((x or "").encode().lower()).digest() for x in batch.column(1).to_pylist()]
        fp = np.array([int.from_bytes(d[:6], "big") for d in digests], np.int64)
        rows = row + np.arange(len(digests))
        row += len(digests)
        yield pa.RecordBatch.from_arrays(
            [pa.array((np.int64(task) << 24) + rows // PART_ROWS), pa.array((np.int64(task) << 40) + rows), batch.column(0), pa.array(fp), pa.array([d.hex() for d in digests])],
            names=["part", "seq", "doc_id", "fp", "sha"],
        )


def _send(owner_bits: int):
    def send(part: pd.DataFrame) -> pd.DataFrame:
        fps, counts = np.unique(part["fp"].to_numpy(), return_counts=True)
        owner = fps >> (FINGERPRINT_BITS - owner_bits)
        out = []
        for o in np.unique(owner):
            own = owner == o
            values = fps[own] - (o << (FINGERPRINT_BITS - owner_bits))
            k = rice_bits(values)
            out.append((o, part["part"].iloc[0], len(values), k, golomb_encode(values, k), np.packbits(counts[own] > 1).tobytes()))
        return pd.DataFrame(out, columns=["owner", "part", "n", "k", "codes", "local"])

    return send


def _own(sent: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps, one for each part that sent something: bit i tells that its i-th fingerprint has another copy."""
    values = [golomb_decode(c, n, k) for c, n, k in zip(sent["codes"], sent["n"], sent["k"])]
    distinct, counts = np.unique(np.concatenate(values), return_counts=True)
    out = []
    for v, part, local, n in zip(values, sent["part"], sent["local"], sent["n"]):
        here = np.unpackbits(np.frombuffer(local, np.uint8))[:n].astype(bool)
        out.append((part, sent["owner"].iloc[0], n, np.packbits(here | (counts[np.searchsorted(distinct, v)] > 1)).tobytes()))
    return pd.DataFrame(out, columns=["part", "owner", "n", "bits"])


def _mark(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    answers = answers.sort_values("owner")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(answers["bits"], answers["n"])]
    fps = np.unique(part["fp"].to_numpy())
    hit = np.concatenate(bits).astype(bool)[np.searchsorted(fps, part["fp"].to_numpy())]
    return part.loc[hit, ["seq", "doc_id", "sha"]]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest id stays (null ids are the smallest; of rows that are repeated
    whole, one stays). An empty table gives an empty result; other columns are not looked at.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    meta = spool(own.mapInArrow(_fingerprints, f"part long, seq long, doc_id {id_type}, fp long, sha string"), "fingerprints")
    owner_bits = max(3, (meta.count() // OWNER_ROWS).bit_length())
    sent = meta.select("part", "fp").groupBy("part").applyInPandas(_send(owner_bits), "owner long, part long, n long, k int, codes binary, local binary")
    answers = sent.groupBy("owner").applyInPandas(_own, "part long, owner long, n long, bits binary")
    suspects = spool(
        meta.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_mark, f"seq long, doc_id {id_type}, sha string"), "suspects"
    )
    # The suspects' texts, compared as bytes: equal grouping keys are equal texts. Rows that the filter lets through besides are alone in their groups.
    texts = hashed_filter(own, suspects, "doc_id").groupBy(F.translate("text", UPPER, LOWER).alias("text")).agg(F.count("*").alias("copies"))
    verified = texts.where("copies > 1").select(F.sha2("text", 256).alias("sha"))
    groups = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "seq")).alias("keep"), F.count("*").alias("size")).join(verified, "sha")
    return meta.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.seq") == F.col("seq"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)
"""
