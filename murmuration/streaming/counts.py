"""Counts by label that a stream of labels keeps up: a label's old value is taken back before its new one is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .generations import newest, rewrite

LATEST = {"value": "boolean", "confidence_milli": "bigint", "rule_version": "string", "reason": "string", "labeled_us": "bigint", "id": "string"}
ROW = "struct<" + ",".join(f"{c}:{t}" for c, t in LATEST.items()) + ">"
#: The newest row of each account and label, what it was before the batch that changed it last, and that batch.
LABELS = f"account_id string, label_key string, latest {ROW}, was {ROW}, changed long"
LABEL_KEYS = ("account_id", "label_key")
COUNT_KEYS = ("label_key", "kind", "name")


def cells(row: tuple) -> list[tuple[str, str, int]]:
    """(kind, name, milli) of the counts that a label's row belongs to; `_cells` is the same of a column."""
    value, milli, version, reason, at, _ = row
    out = [("value", str(value).lower(), milli), ("decile", str(min(milli // 100, 9)), 0), ("version", version, 0), ("minute", str(at // 60_000_000), 0)]
    return [*out, ("reason", reason, 0)] if value else out


def _cells(row: Column) -> Column:
    """Array of (kind, name, milli)."""
    cell = lambda kind, name, milli=F.lit(0): F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), milli.cast("long").alias("milli"))
    value, at = F.coalesce(row["value"], F.lit(False)), row["labeled_us"]
    minute = ((at - F.pmod(at, F.lit(60_000_000))) / 60_000_000).cast("long")
    out = F.array(cell("value", value, row["confidence_milli"]), cell("decile", F.least(F.floor(row["confidence_milli"] / 100), F.lit(9))), cell("version", row["rule_version"]), cell("minute", minute))
    return F.when(row.isNull(), F.slice(out, 1, 0)).when(value, F.concat(out, F.array(cell("reason", row["reason"])))).otherwise(out)


def newer(stored: DataFrame, batch: DataFrame, number: int) -> DataFrame:
    """The labels (as in LABELS) with a batch of rows; late, older rows change nothing."""
    place = lambda r: F.struct(r["labeled_us"], r["id"])
    row = F.struct(*[F.col(c).cast(t).alias(c) for c, t in LATEST.items()])
    best = batch.select(*LABEL_KEYS, row.alias("new")).groupBy(*LABEL_KEYS).agg(F.max_by("new", F.struct("new.labeled_us", "new.id", "new")).alias("new"))
    old, new = F.col("latest"), F.col("new")
    changes = new.isNotNull() & (old.isNull() | ((place(old) <= place(new)) & ~old.eqNullSafe(new)))
    now = stored.join(best, list(LABEL_KEYS), "full_outer").withColumn("changes", changes)
    return now.select(*LABEL_KEYS, F.when(F.col("changes"), new).otherwise(old).alias("latest"), F.when(F.col("changes"), old).alias("was"), F.when(F.col("changes"), F.lit(number)).otherwise(F.col("changed")).cast("long").alias("changed"))


def moved(labels: DataFrame, number: int) -> DataFrame:
    """label_key, kind, name, n, milli: what a batch changes in the counts; cells that a label's old and new row share cancel out."""
    signed = lambda col, sign: F.transform(_cells(F.col(col)), lambda c: F.struct(c["kind"].alias("kind"), c["name"].alias("name"), F.lit(sign).cast("long").alias("n"), (c["milli"] * sign).alias("milli")))
    each = labels.where(F.col("changed") == number).select("label_key", F.explode(F.concat(signed("was", -1), signed("latest", 1))).alias("c")).select("label_key", "c.*")
    return each.groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n"), F.sum("milli").alias("milli")).where("n <> 0 OR milli <> 0")


def added_up(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts with changes; those that fall to nothing go."""
    both = stored.select("label_key", "kind", "name", "n", "milli").unionByName(changes.select("label_key", "kind", "name", "n", "milli"))
    return both.groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n"), F.sum("milli").alias("milli")).where("n > 0")


def keep_counts(labels: DataFrame, folder: str) -> DataStreamWriter:
    """A writer of the counts (label_key, kind, name, n, milli) of all labels' newest rows, read by `generations.newest`.

    Labels (account_id, label_key and LATEST) lie beside the counts in a table of their own, which a batch joins once; a batch that runs again finds both as they were before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rewrite(batch, number, f"{folder}/labels", LABEL_KEYS, spark.createDataFrame([], LABELS).schema, lambda stored, new: newer(stored, new, number))
        summed = moved(newest(spark, f"{folder}/labels", LABELS), number).persist()  # read twice: touched buckets, merge
        try:
            rewrite(summed, number, folder, COUNT_KEYS, summed.schema, added_up)
        finally:
            summed.unpersist()

    return labels.writeStream.outputMode("append").foreachBatch(merge)
