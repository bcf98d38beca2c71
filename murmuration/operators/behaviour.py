"""Behavioural features of accounts, and rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import confidence, posterior_at_least, ramp

DAY_US = 86_400_000_000


def recent(tweets: DataFrame, k: int) -> DataFrame:
    """The k newest tweets of each account; ties go to the larger id."""
    order = Window.partitionBy("account_id").orderBy(F.col("at_us").desc(), F.col("id").desc())
    return tweets.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def ratios(tweets: DataFrame) -> DataFrame:
    """By account: tweets, shares of replies, retweets and originals, and whether any is promoted."""
    by = tweets.groupBy("account_id").agg(F.count("*").alias("n"), F.count_if("is_reply").alias("replies"), F.count_if("is_retweet").alias("retweets"), F.count_if(~F.col("is_reply") & ~F.col("is_retweet")).alias("originals"), F.bool_or("is_promoted").alias("promoted"))
    share = lambda c: (F.col(c) / F.col("n")).alias(f"{c}_ratio")
    return by.select("account_id", "n", "replies", "retweets", "originals", "promoted", share("replies"), share("retweets"), share("originals"))


def gaps(tweets: DataFrame) -> DataFrame:
    """By account: number of gaps between tweets, and their coefficient of variation (0 where the mean is 0), in whole milliseconds."""
    ms = F.floor(F.col("at_us") / 1000)
    gap = ms - F.lag(ms).over(Window.partitionBy("account_id").orderBy("at_us", "id"))
    by = tweets.withColumn("gap", gap.cast("double")).where("gap IS NOT NULL").groupBy("account_id").agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("deviation"))
    return by.select("account_id", "gaps", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("deviation") / F.col("mean")).alias("variation"))


def sliding_targets(tweets: DataFrame, window_us: int = DAY_US) -> DataFrame:
    """By account: of all windows of 24 h that start at a reply, most distinct targets; then most replies, then the shortest span.

    One sorted pass over an account's times. A reply is in the windows that start in the day up to it; it is the first of its target in
    those that start behind the reply to that target before. Both are counted by running sums over the ends of these stretches, and the last reply of
    a window is the last one met before the window's end, so a busy day costs no more than its rows.
    """
    replies = tweets.where(F.col("is_reply") & F.col("in_reply_to").isNotNull()).select("account_id", "id", F.col("in_reply_to").alias("target"), F.col("at_us").alias("at"))
    before = F.lag("at").over(Window.partitionBy("account_id", "target").orderBy("at", "id"))
    rows = replies.withColumn("before", before)
    begins = F.col("at") - window_us
    late = F.coalesce(F.col("before") >= begins, F.lit(False))

    def step(t: Column, phase: int, targets: Column | int, replies: int, anchor: bool = False, seen: bool = False) -> Column:
        told = {"t": t, "phase": F.lit(phase), "targets": targets if isinstance(targets, Column) else F.lit(targets), "replies": F.lit(replies), "anchor": F.col("id").cast("string") if anchor else F.lit(None).cast("string"), "seen": F.col("at") if seen else F.lit(None).cast("long")}
        return F.struct(*[c.alias(k) for k, c in told.items()])

    # At one time: stretches that begin there, then windows, then stretches that end there or begin behind it, then the ends of windows.
    steps = [
        step(begins, 0, F.when(late, 0).otherwise(1), 1), step(F.col("at"), 1, 0, 0, anchor=True, seen=True), step(F.col("at"), 2, -1, -1), step(F.col("at") + window_us, 3, 0, 0, anchor=True), F.when(late, step(F.col("before"), 2, 1, 0)),
    ]
    steps = F.explode(F.array_compact(F.array(*steps)))
    so_far = Window.partitionBy("account_id").orderBy("t", "phase").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.select("account_id", "at", steps.alias("s")).select("account_id", "at", "s.*")
    swept = each.select("account_id", "at", "phase", "anchor", F.sum("targets").over(so_far).alias("targets"), F.sum("replies").over(so_far).alias("replies"), F.last("seen", ignorenulls=True).over(so_far).alias("last")).where("anchor IS NOT NULL")
    by = swept.groupBy("account_id", "anchor").agg(F.max(F.when(F.col("phase") == 1, F.col("targets"))).alias("targets"), F.max(F.when(F.col("phase") == 1, F.col("replies"))).alias("replies"), (F.max(F.when(F.col("phase") == 3, F.col("last"))) - F.max("at")).alias("span_us"))
    best = by.groupBy("account_id").agg(F.max(F.struct("targets", "replies", (-F.col("span_us")).alias("s"))).alias("b"))
    return best.select("account_id", F.col("b.targets").cast("long").alias("targets"), "b.replies", (-F.col("b.s")).alias("span_us"))


def duplicate_replies(replies: DataFrame) -> DataFrame:
    """By normalised text (20 characters or more; shorter ones are empty and don't count): authors, known targets, replies, and whether a target is unknown.

    `others` is how many accounts an author shares the text with: none if all targets are known and one and the same.
    """
    # Counted by pair first, so that a text of many replies reaches one task as its pairs alone.
    pairs = replies.where("text <> ''").groupBy("text", "account_id", "target").agg(F.count("*").alias("n"))
    by = pairs.groupBy("text").agg(F.count_distinct("account_id").alias("authors"), F.count_distinct("target").alias("targets"), F.sum("n").alias("n"), F.bool_or(F.col("target").isNull()).alias("unknown_target"))
    campaign = ~F.col("unknown_target") & (F.col("targets") == 1)
    return by.withColumn("others", F.when(campaign, 0).otherwise(F.col("authors") - 1).cast("long"))


def retweet_rule(tweets: DataFrame) -> DataFrame:
    """Accounts that mostly retweet: value, confidence, evaluable."""
    rows = ratios(tweets)
    value, evaluable = (F.col("n") >= 5) & (F.col("retweets_ratio") >= 0.2), F.col("n") >= 5
    score = F.least(ramp(F.col("n"), 5, 5), ramp(F.col("retweets_ratio"), 0.2, 0.2))
    return rows.select("account_id", F.lit("retweet_heavy").alias("label_key"), value.alias("value"), F.round(confidence(value, score, evaluable), 9).alias("confidence"), evaluable.alias("evaluable"))


def reply_posterior(tweets: DataFrame, rate: float = 0.5) -> DataFrame:
    """Probability that an account's reply rate is at least `rate`."""
    return ratios(tweets).select("account_id", "n", "replies", F.round(posterior_at_least(F.col("replies").cast("int"), F.col("n").cast("int"), rate), 9).alias("posterior"))


def profile_rules(accounts: DataFrame) -> DataFrame:
    """Verified kinds and self-declared kinds, in long form; confidence is 1 either way, and they can always be judged."""
    told = lambda *names: F.concat(F.lit("API reported "), *[x for i, (label, col) in enumerate(names) for x in (F.lit(f"{', ' if i else ''}{label}="), F.coalesce(F.col(col).cast("string"), F.lit("null")))])
    blue, kind, trade, own = ("isBlueVerified", "is_blue_verified"), ("verifiedType", "verified_type"), ("professionalType", "professional_type"), ("parodyCommentaryFanLabel", "self_label")
    individual = F.col("is_blue_verified") & F.coalesce(F.col("verified_type") == "None", F.lit(True))
    is_ = lambda col, value: F.coalesce(F.col(col) == value, F.lit(False))
    rules = {
        "verified_blue_individual": (individual, told(blue, kind)), "verified_blue_creator": (individual & is_("professional_type", "Creator"), told(blue, kind, trade)),
        "verified_blue_professional_business": (individual & is_("professional_type", "Business"), told(blue, kind, trade)), "verified_business": (is_("verified_type", "Business"), told(kind)), "verified_government": (is_("verified_type", "Government"), told(kind)),
        "parody_account": (is_("self_label", "Parody"), told(own)), "commentary_account": (is_("self_label", "Commentary"), told(own)), "fan_account": (is_("self_label", "Fan"), told(own)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label_key"), F.lit("1.0.0").alias("rule_version"), v.alias("value"), F.lit(1.0).alias("confidence"), F.lit(True).alias("evaluable"), r.alias("reason")) for k, (v, r) in rules.items()]))
    return accounts.select(F.col("id").alias("account_id"), each.alias("r")).select("account_id", "r.*")
