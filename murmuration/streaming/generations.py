"""Tables that a stream's batches rewrite, bucket by bucket.

Rows lie in buckets by a hash of their key. A batch reads and rewrites the buckets that it touches and no others;
a small list for each batch names the batch that wrote each bucket last. A batch that runs again starts from the
list before it and writes the same folders, so it gives the same table. Two generations stay, older ones go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
LIST = "bucket int, written long"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _batches(spark: SparkSession, folder: str) -> list[int]:
    fs, p = _path(spark, folder)
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()) if fs.exists(p) else []


def _listed(spark: SparkSession, folder: str, number: int | None) -> dict[int, int]:
    """The batch that wrote each bucket last, as of a batch; BUCKETS entries at most."""
    if number is None:
        return {}
    return {r["bucket"]: r["written"] for r in spark.read.schema(LIST).parquet(f"{folder}/lists/batch={number}").collect()}


def _rows(spark: SparkSession, folder: str, schema, listed: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/rows/batch={n}/bucket={b}" for b, n in sorted(listed.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def newest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table as of the last batch."""
    done = _batches(spark, f"{folder}/lists")
    return _rows(spark, folder, schema, _listed(spark, folder, done[-1] if done else None))


def rewrite(batch: DataFrame, number: int, folder: str, keys: tuple[str, ...], schema, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge a batch into the table: `merge` gets the stored rows of the touched buckets (of `schema`) and the batch, and gives those buckets' new rows."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    earlier = [n for n in _batches(spark, f"{folder}/lists") if n < number]
    before = _listed(spark, folder, earlier[-1] if earlier else None)
    touched = {r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()}  # `buckets` numbers at most
    merged = merge(_rows(spark, folder, schema, {b: n for b, n in before.items() if b in touched}), batch)
    merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/batch={number}")
    written = set(_batches(spark, f"{folder}/rows/batch={number}"))
    now = {b: n for b, n in before.items() if b not in touched} | dict.fromkeys(written, number)
    spark.createDataFrame(sorted(now.items()), LIST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists/batch={number}")
    needed = set(now.items()) | set(before.items())
    for n in earlier[:-1]:
        for b, w in _listed(spark, folder, n).items():
            if (b, w) not in needed:
                fs, p = _path(spark, f"{folder}/rows/batch={w}/bucket={b}")
                fs.delete(p, True)
        fs, p = _path(spark, f"{folder}/lists/batch={n}")
        fs.delete(p, True)
