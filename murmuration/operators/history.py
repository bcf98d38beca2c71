"""Label history: latest, previous, compaction, changes, snapshots and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import decile_diagnostic, decile_trigger

KEY = ("account_id", "label_key")


def _newest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("labeled_at").desc(), F.col("id").desc())


def nth_latest(history: DataFrame, n: int = 1) -> DataFrame:
    """The n-th newest row of each account and label; ties go to the larger id."""
    return history.withColumn("__n", F.row_number().over(_newest(*KEY))).where(F.col("__n") == n).drop("__n")


def latest(history: DataFrame) -> DataFrame:
    """As nth_latest(1), by one aggregation with map-side combining instead of a sort."""
    rest = [c for c in history.columns if c not in KEY]
    best = history.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("labeled_at", "id")).alias("__row"))
    return best.select(*KEY, *[F.col(f"__row.{c}").alias(c) for c in rest])


def _before(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*KEY).orderBy("labeled_at", "id"))


def compacted(history: DataFrame) -> DataFrame:
    """Rows that change the value or the rule version of what was before, and first rows."""
    rows = history.withColumns({"__value": _before("value"), "__version": _before("rule_version")})
    return rows.where(F.col("__value").isNull() | ~F.col("value").eqNullSafe(F.col("__value")) | ~F.col("rule_version").eqNullSafe(F.col("__version"))).drop("__value", "__version")


def changes(history: DataFrame) -> DataFrame:
    """added or removed where the value changes, updated where it stays and confidence or reason differ; a first false row is none."""
    rows = history.withColumns({"was": _before("value"), "was_milli": _before("confidence_milli"), "was_reason": _before("reason")})
    differ = ~F.col("confidence_milli").eqNullSafe(F.col("was_milli")) | ~F.col("reason").eqNullSafe(F.col("was_reason"))
    kind = (
        F.when(F.col("was").isNull(), F.when(F.col("value"), "added"))
        .when(F.col("value") & ~F.col("was"), "added").when(~F.col("value") & F.col("was"), "removed")
        .when(differ, "updated")
    )
    return rows.withColumn("change_type", kind).where("change_type IS NOT NULL")


def snapshot(history: DataFrame, population: DataFrame) -> DataFrame:
    """By label: evaluated, true, prevalence, coverage of the population, mean confidence of true and false rows."""
    size = population.agg(F.count("*").alias("population"))
    milli = lambda cond: F.sum(F.when(cond, F.col("confidence_milli")))
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / 1000.0 / F.col(n)).otherwise(0.0)
    by = latest(history).groupBy("label_key").agg(
        F.count("*").alias("evaluated_count"), F.count_if("value").alias("true_count"), F.count_if(~F.col("value")).alias("false_count"),
        milli(F.col("value")).alias("__t"), milli(~F.col("value")).alias("__f"),
    )
    return by.join(F.broadcast(size)).select(
        "label_key", "evaluated_count", "true_count",
        F.when(F.col("evaluated_count") > 0, F.col("true_count") / F.col("evaluated_count")).otherwise(0.0).alias("prevalence"),
        F.when(F.col("population") > 0, F.col("evaluated_count") / F.col("population")).otherwise(0.0).alias("coverage"),
        F.greatest(F.col("population") - F.col("evaluated_count"), F.lit(0)).alias("unknown_count"),
        mean("__t", "true_count").alias("avg_confidence_true"), mean("__f", "false_count").alias("avg_confidence_false"),
    )


def distributions(history: DataFrame) -> DataFrame:
    """Counts of latest rows by value, decile, version and reason (of true rows), in long form; each row counts in up to four parts."""
    rows = latest(history).withColumn("decile", decile_trigger(F.col("confidence_milli") / 1000.0).cast("string"))
    parts = F.explode(
        F.array(
            F.struct(F.lit("value").alias("part"), F.col("value").cast("string").alias("bucket")), F.struct(F.lit("decile").alias("part"), F.col("decile").alias("bucket")),
            F.struct(F.lit("version").alias("part"), F.col("rule_version").alias("bucket")), F.struct(F.when(F.col("value"), "reason").alias("part"), F.col("reason").alias("bucket")),
        )
    )
    return rows.select("label_key", "confidence_milli", parts.alias("p")).where("p.part IS NOT NULL").groupBy("label_key", "p.part", "p.bucket").agg(F.count("*").alias("n"), F.sum("confidence_milli").alias("confidence_milli"))


def diagnostics(history: DataFrame) -> DataFrame:
    """Counts by the diagnostic decile, which differs from the other one at bucket edges."""
    rows = latest(history).withColumn("bucket", F.round(decile_diagnostic(F.col("confidence_milli") / 1000.0) * 10).cast("int"))
    return rows.groupBy("label_key", "bucket").agg(F.count("*").alias("n"), F.count_if("value").alias("n_true"))


def freshness(history: DataFrame, as_of: str, delayed_days: int, stale_days: int) -> DataFrame:
    """Current, delayed and stale latest rows by label at a given time."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("labeled_at").cast("timestamp"))
    day = 86400
    return latest(history).withColumn("age", age).groupBy("label_key").agg(
        F.count_if(F.col("age") <= delayed_days * day).alias("current_count"),
        F.count_if((F.col("age") > delayed_days * day) & (F.col("age") <= stale_days * day)).alias("delayed_count"),
        F.count_if(F.col("age") > stale_days * day).alias("stale_count"),
    )


def account_summary(history: DataFrame) -> DataFrame:
    """By account: active labels, sorted and counted, and the last label time."""
    return latest(history).groupBy("account_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("value"), F.col("label_key")))), ",").alias("active_label_keys"),
        F.count_if("value").alias("active_label_count"), F.count("*").alias("evaluated_label_count"), F.max("labeled_at").alias("last_labeled_at"),
    )


def stale_accounts(accounts: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """Accounts (id) with a rule of `current` (label_key, rule_version; one row for each rule) whose latest row has another version, or that have no row for it."""
    rules = current.agg(F.count("*").alias("rules"))
    fresh = latest(history).join(F.broadcast(current), ["label_key", "rule_version"]).groupBy("account_id").agg(F.count("*").alias("fresh"))
    rows = accounts.select(F.col("id").alias("account_id")).join(fresh, "account_id", "left").join(F.broadcast(rules))
    return rows.where(F.coalesce("fresh", F.lit(0)) < F.col("rules")).select("account_id", F.coalesce("fresh", F.lit(0)).alias("fresh"))


def seeded_sample(history: DataFrame, seed: str, per_stratum: int) -> DataFrame:
    """The first rows of each label and value in the order of a seeded hash."""
    rank = F.md5(F.concat_ws(":", "account_id", "label_key", F.lit(seed)).cast("binary"))
    order = Window.partitionBy("label_key", "value").orderBy("rank", "account_id")
    return latest(history).withColumn("rank", rank).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_stratum).select("label_key", "value", "account_id", "n")


def monthly(history: DataFrame) -> DataFrame:
    """Evaluated and true rows by label and month."""
    return history.groupBy("label_key", F.date_format("labeled_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("evaluated"), F.count_if("value").alias("true_count"))


def count_drops(months: DataFrame, least: int, threshold: float) -> DataFrame:
    """Each month's true rows against the month before: missing when either has fewer than `least` evaluated rows, else the relative drop."""
    over = Window.partitionBy("label_key").orderBy("month")
    rows = months.withColumns({"baseline": F.lag("true_count").over(over), "was": F.lag("evaluated").over(over)}).where("was IS NOT NULL")
    missing = (F.col("evaluated") < least) | (F.col("was") < least)
    drop = F.when(F.col("baseline") == 0, 0.0).otherwise((F.col("baseline") - F.col("true_count")) / F.col("baseline"))
    return rows.select("label_key", "month", "true_count", "baseline", missing.alias("missing"), drop.alias("drop"), (~missing & (drop >= threshold)).alias("exceeded"))


def completed_before(snapshots: DataFrame) -> DataFrame:
    """Each snapshot (label_key, observed, complete, ...) with the newest complete one strictly before it, as struct `baseline` (null without one)."""
    rest = [c for c in snapshots.columns if c != "label_key"]
    over = Window.partitionBy("label_key").orderBy("observed").rowsBetween(Window.unboundedPreceding, -1)
    return snapshots.withColumn("baseline", F.last(F.when(F.col("complete"), F.struct(*rest)), ignorenulls=True).over(over))


def reason_shifts(before: DataFrame, now: DataFrame, least: int, threshold: float) -> DataFrame:
    """By label and reason of either distribution (label_key, reason, n): the relative drop, for reasons with `least` rows or more before."""
    both = before.withColumnRenamed("n", "was").join(now, ["label_key", "reason"], "full_outer").fillna(0, ["was", "n"]).where(F.col("was") >= least)
    drop = F.when(F.col("was") == 0, 0.0).otherwise((F.col("was") - F.col("n")) / F.col("was"))
    return both.select("label_key", "reason", "was", "n", drop.alias("drop"), (drop >= threshold).alias("exceeded"))
