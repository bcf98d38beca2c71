"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}

#: Width of the hashed key domain used by `hashed_filter`; the broadcast side has at most so many longs.
FILTER_BUCKETS = 1 << 18


#: Rows that `small` lets Spark broadcast.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame) -> DataFrame:
    """`df`, a spooled table of narrow rows, marked for broadcast if it has BROADCAST_ROWS rows at most; above, the join is Spark's choice."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a folder of our own where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            _own_root[app] = tempfile.mkdtemp(prefix="llm-shared-")
        root = _own_root[app]
    return root.rstrip("/")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_bucket(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BUCKETS))


def hashed_filter(df: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """Rows of `df` whose key may be in `keys`: a semi join on the key's hash bucket, before anything wide is shuffled.

    At most FILTER_BUCKETS longs are broadcast, however many keys there are. Rows of other keys can
    pass (all of them, when there are far more keys than buckets), so a join on the keys themselves,
    or an operation that other rows can't disturb, follows.
    """
    bits = keys.select(key_bucket(*cols).alias("__bucket")).distinct()
    return df.join(F.broadcast(bits), key_bucket(*(F.col(c) for c in cols)) == F.col("__bucket"), "left_semi")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
