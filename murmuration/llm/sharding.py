"""Sharding by a hypergeometric communication matrix.

How many rows each part of the input sends to each shard is drawn first, from the exact joint
distribution that a uniform shuffle of all rows would give. Each part then permutes its own rows
and deals them out by its row of the matrix, and each shard permutes what it receives. The result is
a uniform shuffle with shard sizes that differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: Rows of a part, about, and parts at most: the matrix has MOST_PARTS * shards counts at most.
PART_ROWS, MOST_PARTS = 2_000, 1 << 12
SLOT_RANGES = 64
#: numpy draws from populations below this alone.
NUMPY_LIMIT = 10**9
#: Standard deviations on either side of the mean that hold all but a share that doubles can't tell from none.
REACH = 12


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of `drawn` are good, by the inverse of the distribution function: for populations of any size, in memory that grows with the standard deviation."""
    least, most = max(0, drawn - bad), min(good, drawn)
    if least >= most:
        return least
    share = good / (good + bad)
    deviation = (drawn * share * (1 - share) * max(0.0, 1 - drawn / (good + bad))) ** 0.5
    low = max(least, int(drawn * share - REACH * deviation) - 50)
    high = min(most, int(drawn * share + REACH * deviation) + 50)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)  # of each probability to the one before
    logs = np.r_[0.0, np.cumsum(ratios)]
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def dealt_out(room: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `n` rows, drawn without replacement, each shard takes of its `room`: one shard after the other, given what the ones before took."""
    if int(room.sum()) < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out, others = np.zeros(len(room), np.int64), int(room.sum())
    for s, own in enumerate(room.tolist()):
        others -= own
        out[s] = hypergeometric(own, others, n, rng)
        n -= int(out[s])
    return out


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[part, shard] of a uniform shuffle of sum(rows) rows into `shards` shards of equal size (one apart at most)."""
    total, rng = sum(rows), np.random.default_rng(seed)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        out[p] = dealt_out(room, n, rng)
        room -= out[p]
    return out


def shard_rows(docs: DataFrame, shards: int, seed: int = 29, id_cols: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """All columns of `docs`, then shard (0 to shards - 1) and slot (0 and up within a shard, no gaps).

    Columns of these names that `docs` has already are replaced. Rows are placed by hashes of
    `id_cols`: the same rows give the same shards, however they are partitioned (rows that are equal
    in them change places freely, among repeated rows too). Nulls are values like others. An empty table
    gives an empty result.
    """
    own = docs.drop("shard", "slot")
    known = [F.col(c) for c in id_cols if c in own.columns]
    n = own.count()
    parts = int(min(MOST_PARTS, max(1, n // PART_ROWS)))
    own = own.withColumns({"__h": F.xxhash64(F.lit(seed), *known)})
    own = own.withColumn("__part", F.pmod(F.xxhash64("__h"), F.lit(parts)).cast("int"))
    sizes = {r["__part"]: r["count"] for r in own.groupBy("__part").count().collect()}  # MOST_PARTS counts at most
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    rows = own.sparkSession.createDataFrame([(p, [int(x) for x in ends[p]]) for p in range(parts)], "__part int, __ends array<long>")
    dealt = (
        own.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(F.xxhash64(F.lit("deal"), "__h"), "__h")).cast("long"))
        .join(F.broadcast(rows), "__part")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))))
        .drop("__ends", "__rank")
    )
    return _permuted(dealt, docs, seed)


def _permuted(dealt: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """Slots: rows of a shard in the order of a second hash, numbered by key range with offsets from the ranges before."""
    second = dealt.withColumn("__g", F.xxhash64(F.lit("permute"), F.lit(seed), "__h", "__part")).withColumn("__range", F.pmod(F.shiftright("__g", 32), F.lit(SLOT_RANGES)).cast("int"))
    counts = second.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = Window.partitionBy("shard", "__range").orderBy("__g", "__h")
    return (
        second.withColumn("__i", F.row_number().over(local) - 1)
        .join(F.broadcast(offsets), ["shard", "__range"])  # shards * SLOT_RANGES rows at most
        .select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", (F.col("__before") + F.col("__i")).cast("long").alias("slot"))
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return shard_rows(docs, 24, id_cols=("doc_id", "text_crc32", "size")).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
