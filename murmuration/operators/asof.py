"""As-of joins of two tables, and the label summary that rests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# The order of severities; others rank as low.
SEVERITIES = ("low", "medium", "high", "critical")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str = "at", order: tuple[str, ...] = (), strict: bool = False, tolerance: int | None = None, stretch: int = 30 * DAY_MS) -> DataFrame:
    """All rows of `left` with `found`: of the rows of `right` with the same keys the newest at or before (`strict`: before) their own time, as a struct, or null.

    `at` is a whole number in both tables; of rows at one time the greatest by `order` counts. A row older than `tolerance` isn't found. Both tables
    run in one sorted stream in which the last row of `right` is carried on, so no row meets a range of rows. A key's stream is cut into stretches of time
    that are sorted apart; what a stretch begins with comes from the ends of those before it, so a key with very many rows is no single task's.
    Null keys are equal to each other; a row without a time finds nothing and isn't found.
    """
    near = [c for c in right.columns if c not in keys]
    part = F.floor(F.col(at) / stretch)
    r = right.where(F.col(at).isNotNull()).select(*keys, at, F.struct(*near).alias("__r"))
    l = left.select(*keys, at, F.struct(*[c for c in left.columns if c not in (*keys, at)]).alias("__l"))  # noqa: E741
    rank = [F.col(f"__r.{c}") for c in order]
    stream = r.withColumn("__side", F.lit(0)).unionByName(l.withColumn("__side", F.lit(-1 if strict else 1)), allowMissingColumns=True).withColumn("__part", part)
    here = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys, "__part").orderBy(at, "__side", *rank))
    ends = stream.groupBy(*keys, "__part").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct(at, *rank))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), before.alias("__before"))
    same = F.col("__part").eqNullSafe(F.col("__of"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = stream.withColumn("__here", here).where(F.col("__side") != 0).join(carried, same, "left")
    found = F.coalesce("__here", "__before")
    valid = F.col(at).isNotNull() & found.isNotNull() & (F.lit(True) if tolerance is None else F.col(at) - found[at] <= tolerance)
    return rows.select(*keys, at, F.col("__l.*"), F.when(valid, found).alias("found")).select(*left.columns, "found")


def severity_place(col: Column) -> Column:
    """0 to 3; unknown ones 0, like low."""
    return F.greatest(F.lit(0), F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col), F.lit(0)).cast("int") - 1)


def active_findings(findings: DataFrame) -> DataFrame:
    """label_key, active_findings and highest_severity of findings (id, label_key, status, severity) that are active or recurring; of equal severities the one of the least id."""
    rows = findings.where(F.col("status").isin("active", "recurring")).groupBy("label_key")
    return rows.agg(F.count("*").alias("active_findings"), F.min_by("severity", F.struct(-severity_place(F.col("severity")), "id")).alias("highest_severity"))


def label_summary(current: DataFrame, snapshots: DataFrame, findings: DataFrame) -> DataFrame:
    """Each snapshot of `current` with its prevalence, how that differs from the newest complete snapshot before it, a day and a week before, its label's active findings and its quality.

    Snapshots: id, label_key, at (ms), evaluated, true_count, completeness. Only complete snapshots are compared, and compared with; without one the difference is null.
    """
    share = lambda e, t: F.when(F.col(e) == 0, 0.0).otherwise(F.col(t) / F.col(e))
    rows = current.withColumn("prevalence", share("evaluated", "true_count"))
    back = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(ms).alias("ms")) for name, ms in (("previous", 1), ("day", DAY_MS), ("week", 7 * DAY_MS))])).alias("b")
    probes = rows.where("completeness = 'complete'").select("id", "label_key", "at", "prevalence", back).select("id", "label_key", (F.col("at") - F.col("b.ms")).alias("at"), "prevalence", F.col("b.name").alias("name"))
    complete = snapshots.where("completeness = 'complete'").select("id", "label_key", "at", share("evaluated", "true_count").alias("then"))
    change = F.col("prevalence") - F.col("found.then")
    deltas = as_of(probes, complete, ["label_key"], order=("id",)).groupBy("id").agg(*[F.max(F.when(F.col("name") == n, change)).alias(f"{n}_delta") for n in ("previous", "day", "week")])
    quality = F.when(F.col("completeness") == "unknown", "unknown").when(F.col("completeness") == "partial", "watch").when(F.col("active_findings") > 0, "attention").otherwise("normal")
    joined = rows.join(deltas, "id", "left").join(active_findings(findings), "label_key", "left").fillna(0, ["active_findings"])
    return joined.select("id", "label_key", "at", "evaluated", "true_count", "prevalence", "previous_delta", "day_delta", "week_delta", "active_findings", "highest_severity", quality.alias("quality"))
