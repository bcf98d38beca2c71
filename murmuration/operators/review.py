"""Review and monitoring: rolling calibration, risk, completeness, freshness, runs of findings, counts with retraction, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import decile_diagnostic
from .history import KEY, changes

# Fixed values of the diagnostics and of the risk score.
LEAST_EFFECTIVE = 20
COMMON_SHARE = 0.6
BINS = 10


def smoothed_rate(successes: Column, trials: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """The mean of a rate with a beta prior; null where the counts make no sense."""
    sound = (successes >= 0) & (trials >= successes)
    return F.when(sound, (successes + alpha) / (trials + alpha + beta))


def relative_delta(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(1.0)).otherwise(F.abs(now - before) / F.abs(before))


def risk_score(findings: Column, recent: Column, shift: Column, coverage: Column, stale: Column) -> Column:
    """1, plus up to 4 for open findings, 3 for recent changes, 3 for a shift of the prevalence, 2 for little coverage, 2 for stale rows. Null measures add nothing."""
    moved = F.when(shift >= 0.3, 3.0).when(shift >= 0.1, 1.0).otherwise(0.0)
    changed = F.when(recent > 0, F.least(F.lit(3.0), F.log2(recent + 1))).otherwise(0.0)
    return F.round(1 + F.least(F.lit(4), F.coalesce(findings, F.lit(0)) * 2) + changed + moved + F.when(coverage < 0.8, 2).otherwise(0) + F.when(stale > 0.1, 2).otherwise(0), 3)


def completeness(coverage: Column, stale: Column, least_coverage: float, most_stale: float) -> Column:
    return F.when(coverage < least_coverage, "unknown").when(stale > most_stale, "partial").otherwise("complete")


def freshness_status(age_s: Column, delayed_s: int, stale_s: int) -> Column:
    """unknown without an age; the bounds themselves are delayed and stale already."""
    return F.when(age_s.isNull(), "unknown").when(age_s >= stale_s, "stale").when(age_s >= delayed_s, "delayed").otherwise("current")


def bucket_key(bucket: Column) -> Column:
    """0 is 0.0-0.1, 9 is 0.9-1.0."""
    return F.concat(F.format_number(bucket / BINS, 1), F.lit("-"), F.format_number((bucket + 1) / BINS, 1))


def stable_rank(seed: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), value).cast("binary"), 256)


def rolling_calibration(judgments: DataFrame) -> DataFrame:
    """By label, value and run: judgments so far by confidence bin, since the cell's rule version last changed.

    judgments: label_key, value, run, seq (order in the run), rule_version, confidence_milli, correct, weight (long).
    A bin with fewer than LEAST_EFFECTIVE effective judgments has neither rate nor Brier score. Sums are of whole numbers
    until the last division. Each run and cell is spread over the ten bins, so sums so far are one window by cell, version and bin.
    """
    cell = Window.partitionBy("label_key", "value").orderBy("run", "seq")
    turn = F.when(F.lag("rule_version").over(cell).eqNullSafe(F.col("rule_version")), 0).otherwise(1)
    rows = judgments.withColumn("turn", turn).withColumn("stretch", F.sum("turn").over(cell))
    w, miss = F.col("weight"), F.col("confidence_milli") - F.when(F.col("correct"), 1000).otherwise(0)
    bins = F.round(decile_diagnostic(F.col("confidence_milli") / 1000.0) * 10).cast("int")
    sums = rows.groupBy("label_key", "value", "stretch", "run", bins.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(F.when(F.col("correct"), w).otherwise(0)).alias("right"), F.sum(w * miss * miss).alias("missed")
    )
    last = rows.groupBy("label_key", "value", "run").agg(F.max_by(F.struct("stretch", "rule_version"), "seq").alias("l"))
    grid = last.select("label_key", "value", "run", "l.stretch", "l.rule_version", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    so_far = Window.partitionBy("label_key", "value", "stretch", "bin").orderBy("run")
    full = grid.join(sums, ["label_key", "value", "stretch", "run", "bin"], "left")
    full = full.select("label_key", "value", "run", "rule_version", "bin", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("n", "w", "w2", "right", "missed")]).where("n > 0")
    effective = F.col("w").cast("double") * F.col("w") / F.col("w2")
    enough = effective >= LEAST_EFFECTIVE
    return full.select(
        "label_key", "value", "run", "rule_version", "bin", "n", effective.alias("n_eff"), F.when(enough, F.col("right") / F.col("w")).alias("correctness"), F.when(enough, F.col("missed") / 1e6 / F.col("w")).alias("brier")
    )


def without_common_words(texts: DataFrame) -> DataFrame:
    """Of normalised texts (grp, id, text): each without the words (two UTF-16 units or more) that 60 % of its group's texts have.

    A text of such words alone stays as it is, and so does a group of one text. Counts are by group and word: nothing gathers a group.
    """
    words = texts.select("grp", "id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("word <> ''")
    long_enough = F.octet_length(F.encode("word", "UTF-16BE")) >= 4
    sizes = texts.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    common = words.where(long_enough).select("grp", "id", "word").distinct().groupBy("grp", "word").agg(F.count("*").alias("n"))
    common = common.join(sizes, "grp").where(F.col("n") >= F.ceil(F.col("size") * COMMON_SHARE)).select("grp", "word")
    rest = words.join(common, ["grp", "word"], "left_anti").groupBy("grp", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("left"))  # of one text's words
    return texts.join(rest, ["grp", "id"], "left").select("grp", "id", F.coalesce(F.array_join("left.word", " "), "text").alias("text"))


def exceeded_in_a_row(observations: DataFrame) -> DataFrame:
    """By label: exceeded observations since the newest normal one; missing ones neither count nor end the run."""
    seen = observations.where(~F.col("missing"))
    normal = seen.groupBy("label_key").agg(F.max(F.when(~F.col("exceeded"), F.col("month"))).alias("normal"))
    later = F.col("normal").isNull() | (F.col("month") > F.col("normal"))
    return seen.join(F.broadcast(normal), "label_key").groupBy("label_key").agg(F.count_if(later).alias("run"))


def active_counts(history: DataFrame) -> DataFrame:
    """Active accounts by label from the changes alone: each adds one or takes one back."""
    delta = F.when(F.col("change_type") == "added", 1).when(F.col("change_type") == "removed", -1).otherwise(0)
    return changes(history).groupBy("label_key").agg(F.sum(delta).alias("active"))


def freshness_buckets(rows: DataFrame, as_of: Column, kept_days: int = 7) -> DataFrame:
    """Rows (label_key, labeled_at) by minute; minutes more than `kept_days` before `as_of` share the sentinel 1970-01-01."""
    old = F.date_trunc("minute", "labeled_at") < as_of - F.make_dt_interval(F.lit(kept_days))
    minute = F.when(old, F.lit("1970-01-01 00:00")).otherwise(F.date_format("labeled_at", "yyyy-MM-dd HH:mm"))
    return rows.groupBy("label_key", minute.alias("bucket")).agg(F.count("*").alias("n"))


def top_per_key(rows: DataFrame, keys: tuple[str, ...], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key; Spark's group limit cuts each task's rows before they are shuffled."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def dominant(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """By key: how many kinds, how many rows, and the most frequent kind, the least of those as frequent."""
    counts = rows.groupBy(key, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.min_by(kind, F.struct(-F.col("n"), kind)).alias("dominant"))


def newest_changes(history: DataFrame, begin: str, end: str) -> DataFrame:
    """Of the changes at or between both times, those with no newer one of the same account and label in that window."""
    inside = changes(history).where(F.col("labeled_at").between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    best = inside.groupBy(*KEY).agg(F.max_by(F.struct("id", "change_type"), F.struct("labeled_at", "id")).alias("r"))
    return best.select(*KEY, "r.id", "r.change_type")


def worst(rows: DataFrame, key: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """By key the worst status; `order` names them from best to worst, others count as better than all."""
    names = F.array(*[F.lit(x) for x in order])
    rank = F.max(F.array_position(names, F.col(status))).alias("rank")
    return rows.groupBy(key).agg(rank).select(key, F.when(F.col("rank") > 0, F.element_at(names, F.greatest(F.col("rank"), F.lit(1)).cast("int"))).otherwise("unknown").alias("status"))
