"""Daily metrics, the life cycle of findings, and policies replayed over past snapshots."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of

DAY_MS = 86_400_000
OPEN = ("active", "recurring", "new_episode")


class Rule(NamedTuple):
    """One rule of a policy; durations in milliseconds, None where there is none."""

    type: str
    severity: str
    relative_threshold: float
    minimum_sample: int
    activation: int = 2
    resolution: int = 2
    recurrence_ms: int | None = 30 * DAY_MS
    cooldown_ms: int | None = 3_600_000
    critical_immediate: bool = False
    enabled: bool = True
    baseline_window: str = "previous_cycle"
    activation_threshold: float | None = None
    resolution_threshold: float | None = None


def daily(snapshots: DataFrame) -> DataFrame:
    """Of snapshots (label_key, observed, evaluated, true_count) the last one of each day and label, with the change of true_count since the day before that has one."""
    last = snapshots.groupBy("label_key", F.to_date("observed").alias("day")).agg(F.max_by(F.struct("evaluated", "true_count"), "observed").alias("s"))
    before = F.lag("s.true_count").over(Window.partitionBy("label_key").orderBy("day"))
    return last.select("label_key", F.date_format("day", "yyyy-MM-dd").alias("day"), "s.evaluated", "s.true_count", (F.col("s.true_count") - before).alias("change"))


def duration_ms(duration: str, strict: bool = False) -> int:
    """Milliseconds of an ISO-8601 duration of days, hours and minutes; `strict` refuses one without any part."""
    found = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?)?", duration)
    if not found or (strict and not any(found.groups())):
        raise ValueError(f"unsupported duration: {duration}")
    days, hours, minutes = (int(x or 0) for x in found.groups())
    return ((days * 24 + hours) * 60 + minutes) * 60_000


def _after(s: Column, o: Column, rule: Rule) -> Column:
    """The state after one observation. What happens is a table of five cases: counting up, opening, falling back, staying open, and winding down."""
    idle = ~s["status"].isin(*OPEN)
    exceeds, normals = s["exceeds"] + 1, s["normals"] + 1
    since = o["at"] - s["resolved_at"]
    cooling = F.coalesce(since < rule.cooldown_ms, F.lit(False)) if rule.cooldown_ms else F.lit(False)
    again = F.coalesce(since <= rule.recurrence_ms, F.lit(False)) if rule.recurrence_ms else F.lit(False)
    opens = idle & o["exceeded"] & (exceeds >= (1 if rule.critical_immediate else rule.activation)) & ~cooling
    resolves = ~idle & ~o["exceeded"] & (normals >= rule.resolution)
    status = F.when(opens, F.when(s["status"] == "none", "active").otherwise(F.when(again, "recurring").otherwise("new_episode"))).when(resolves, "resolved").otherwise(s["status"])
    state = {
        "status": status,
        "exceeds": F.when(idle, F.when(o["exceeded"], exceeds).otherwise(0)).when(resolves, 0).otherwise(s["exceeds"]),
        "normals": F.when(o["exceeded"], 0).when(idle, s["normals"]).otherwise(normals),
        "resolved_at": F.when(resolves, o["at"]).when(~opens, s["resolved_at"]),
        "opened": opens,
    }
    kept = {k: F.when(o["missing"], F.lit(False) if k == "opened" else s[k]).otherwise(v) for k, v in state.items()}
    return F.struct(*[v.alias(k) for k, v in kept.items()])


STATE = "struct<status:string,exceeds:bigint,normals:bigint,resolved_at:bigint,opened:boolean>"


def lifecycle(observations: DataFrame, rule: Rule, key: str = "label_key") -> DataFrame:
    """Each observation (`key`, at in ms, missing, exceeded) with the finding's status, exceeds, normals and resolved_at after it, and whether it opened an episode.

    One key's observations are folded in order of time inside one row; they are as many as the checks of one label, however many rows the checks looked at. A missing observation changes nothing.
    """
    start = F.expr("named_struct('status', 'none', 'exceeds', 0L, 'normals', 0L, 'resolved_at', cast(null as bigint), 'opened', false)").cast(STATE)
    series = observations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "missing", "exceeded"))).alias("series"))
    none = F.array().cast(f"array<struct<at:bigint,state:{STATE}>>")
    folded = F.aggregate(
        "series",
        F.struct(start.alias("now"), none.alias("out")),
        lambda acc, o: _stepped(acc, o, _after(acc["now"], o, rule).cast(STATE)),
        lambda acc: acc["out"],
    )
    return series.select(key, F.explode(folded).alias("o")).select(key, "o.at", "o.state.*")


def _stepped(acc: Column, o: Column, state: Column) -> Column:
    return F.struct(state.alias("now"), F.concat(acc["out"], F.array(F.struct(o["at"].alias("at"), state.alias("state")))).alias("out"))


def fingerprint(type_: Column, label: Column, reason: Column | None = None) -> Column:
    """type+label:<label>, and +reason:<reason> where there is one."""
    plain = F.concat(type_, F.lit("+label:"), label)
    return plain if reason is None else F.concat(plain, F.coalesce(F.concat(F.lit("+reason:"), reason), F.lit("")))


def comparisons(snapshots: DataFrame, reasons: DataFrame, baseline: str = "previous") -> DataFrame:
    """id, label_key, at, type, reason, was, now, was_evaluated, evaluated: what the comparing rules look at, for each snapshot.

    Snapshots: id, label_key, at (ms), evaluated, true_count; reasons: id, reason, n. `previous` compares with the snapshot before, and leaves out a label's first one; `any` compares
    first ones with nothing. The reasons of both snapshots are lined up by key, the absent ones as 0.
    """
    rows = as_of(snapshots.select("label_key", "at", "id", "evaluated", "true_count"), snapshots.select("label_key", "at", "id", "evaluated", "true_count"), ["label_key"], order=("id",), strict=True)
    return _compared(rows.where("found IS NOT NULL") if baseline == "previous" else rows, reasons)


def _compared(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """The comparisons of snapshots with the ones in their struct `found`, or with nothing where it is null."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    drops = rows.select("id", "label_key", "at", F.lit("label_count_drop").alias("type"), F.lit(None).cast("string").alias("reason"), zero(F.col("found.true_count")).alias("was"), F.col("true_count").alias("now"), zero(F.col("found.evaluated")).alias("was_evaluated"), "evaluated")
    pairs = rows.select("id", "label_key", "at", F.col("found.id").alias("before"))
    both = pairs.join(reasons, "id").select("id", "label_key", "at", "reason", F.lit(0).cast("long").alias("was"), F.col("n").alias("now")).unionByName(
        pairs.join(reasons.withColumnRenamed("id", "before"), "before").select("id", "label_key", "at", "reason", F.col("n").alias("was"), F.lit(0).cast("long").alias("now"))
    )
    shifts = both.groupBy("id", "label_key", "at", "reason").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    return drops.unionByName(shifts.select("id", "label_key", "at", F.lit("reason_distribution_shift").alias("type"), "reason", "was", "now", F.col("was").alias("was_evaluated"), F.col("was").alias("evaluated")))


def _rule(policy: tuple[Rule, ...], name: str, value) -> Column:
    """A field of the enabled rule of each comparison's type; null without one."""
    out = F.lit(None)
    for r in policy:
        if r.enabled:
            out = F.when(F.col("type") == r.type, F.lit(value(r))).otherwise(out)
    return out.alias(name)


def judged(compared: DataFrame, policy: tuple[Rule, ...], suffix: str = "") -> DataFrame:
    """Adds missing, drop and exceeded; comparisons whose type the policy has no enabled rule for have no verdict, and reasons below the sample aren't judged either."""
    least, most = _rule(policy, "least", lambda r: r.minimum_sample), _rule(policy, "most", lambda r: float(r.relative_threshold))
    short = (F.col("evaluated") < least) | (F.col("was_evaluated") < least)
    drop = F.when(F.col("was") == 0, 0.0).otherwise((F.col("was") - F.col("now")) / F.col("was"))
    applies = least.isNotNull() & ((F.col("type") == "label_count_drop") | ~short)
    return compared.withColumns({f"missing{suffix}": F.when(applies, short), f"drop{suffix}": F.when(applies, drop), f"exceeded{suffix}": F.when(applies, ~short & (drop >= most))})


def backtest(snapshots: DataFrame, reasons: DataFrame, candidate: tuple[Rule, ...], baseline: tuple[Rule, ...], begin: int, end: int) -> DataFrame:
    """snapshot_id, fingerprint, severity, diff_kind: where two policies judge the same snapshot differently, both compared with the one before it in the time from `begin` to `end`.

    Both policies look at one set of comparisons in one pass, so nothing is joined to find what differs.
    """
    compared = comparisons(snapshots.where(F.col("at").between(begin, end)), reasons)
    both = judged(judged(compared, candidate, "_new"), baseline, "_old")
    new, old = (F.coalesce(c, F.lit(False)) for c in ("exceeded_new", "exceeded_old"))
    severity = F.when(new, _rule(candidate, "s", lambda r: r.severity)).otherwise(_rule(baseline, "s", lambda r: r.severity))
    return both.where(new != old).select(F.col("id").alias("snapshot_id"), fingerprint(F.col("type"), F.col("label_key"), F.col("reason")).alias("fingerprint"), severity.alias("severity"), F.when(new, "new_in_candidate").otherwise("missing_in_candidate").alias("diff_kind"))


def shadow(snapshots: DataFrame, reasons: DataFrame, policy: tuple[Rule, ...]) -> DataFrame:
    """snapshot_id, fingerprint, missing, observed, baseline, drop, exceeded: what a policy says of each snapshot against the one before it, complete or not; nothing is stored as a finding."""
    rows = judged(comparisons(snapshots, reasons, "any"), policy).where("exceeded IS NOT NULL")
    return rows.select(F.col("id").alias("snapshot_id"), fingerprint(F.col("type"), F.col("label_key"), F.col("reason")).alias("fingerprint"), "missing", F.col("now").alias("observed"), F.col("was").alias("baseline"), "drop", "exceeded")


def episodes(compared: DataFrame, rule: Rule) -> DataFrame:
    """fingerprint, opened_at, kind (active, recurring or new_episode) and resolved_at (null while it is open) of the episodes that a rule gives over all comparisons of its type."""
    rows = judged(compared.where(F.col("type") == rule.type), (rule,)).where("exceeded IS NOT NULL")
    states = lifecycle(rows.select(fingerprint(F.col("type"), F.col("label_key"), F.col("reason")).alias("fingerprint"), "at", "missing", "exceeded"), rule, "fingerprint")
    number = F.count_if("opened").over(Window.partitionBy("fingerprint").orderBy("at"))
    by = states.withColumn("episode", number).where("episode > 0").groupBy("fingerprint", "episode")
    found = by.agg(F.min("at").alias("opened_at"), F.min_by("status", "at").alias("kind"), F.max("resolved_at").alias("resolved_at"))
    return found.drop("episode")


def replayed(compared: DataFrame, candidate: Rule, baseline: Rule) -> DataFrame:
    """The episodes that two rules of one type give over the same comparisons, side by side: fingerprint, opened_at, new_kind, new_resolved_at, old_kind, old_resolved_at and diff (same, changed, new, gone)."""
    sides = [episodes(compared, r).select("fingerprint", "opened_at", F.col("kind").alias(f"{p}_kind"), F.col("resolved_at").alias(f"{p}_resolved_at")) for r, p in ((candidate, "new"), (baseline, "old"))]
    rows = sides[0].join(sides[1], ["fingerprint", "opened_at"], "full_outer")
    same = (F.col("new_kind") == F.col("old_kind")) & F.col("new_resolved_at").eqNullSafe(F.col("old_resolved_at"))
    return rows.withColumn("diff", F.when(F.col("old_kind").isNull(), "new").when(F.col("new_kind").isNull(), "gone").when(same, "same").otherwise("changed"))


WINDOWS = {"previous_cycle": 0, "seven_day": 7 * DAY_MS}
KEPT = ("at", "missing", "drop", "now", "was")


def observations(snapshots: DataFrame, reasons: DataFrame, rule: Rule) -> DataFrame:
    """fingerprint, label_key, at, missing, drop, now, was: what a rule sees of each complete snapshot, against the newest complete one of a crawl before it (or more than seven days before).

    Snapshots: id, label_key, at (ms), evaluated, true_count, completeness, crawled. Without a baseline, counts are compared with 0. A reason is seen where its baseline has rows enough.
    """
    back = WINDOWS[rule.baseline_window]
    complete = snapshots.where("completeness = 'complete'")
    pool = complete.where("crawled").select("label_key", "at", "id", "evaluated", "true_count")
    probes = complete.select("label_key", (F.col("at") - back).alias("at"), "id", "evaluated", "true_count")
    rows = as_of(probes, pool, ["label_key"], order=("id",), strict=True).withColumn("at", F.col("at") + back)
    seen = judged(_compared(rows, reasons).where(F.col("type") == rule.type), (rule,)).where("exceeded IS NOT NULL")
    return seen.select(fingerprint(F.col("type"), F.col("label_key"), F.col("reason")).alias("fingerprint"), "label_key", "at", "missing", "drop", "now", "was")


def _lived(s: Column, o: Column, rule: Rule) -> Column:
    """The state after one observation, of findings that are kept: the threshold is another one while a finding is open, and each look at a resolved finding that leaves it so counts as its resolution."""
    usual = lambda t: float(rule.relative_threshold if t is None else t)
    bound = F.when(s["status"].isin(*OPEN), usual(rule.resolution_threshold)).otherwise(usual(rule.activation_threshold))
    after = _after(s, F.struct(o["at"].alias("at"), o["missing"].alias("missing"), (~o["missing"] & (o["drop"] >= bound)).alias("exceeded")), rule)
    return after.withField("resolved_at", F.when(after["status"] == "resolved", o["at"]).otherwise(after["resolved_at"]))


def occurrences(seen: DataFrame, rule: Rule) -> DataFrame:
    """fingerprint, label_key, episode, at, transition, recurrences, severity, now, was, drop: every observation of a finding from its first opening on.

    A finding that opens again soon goes on in its episode as recurring; later it begins the next episode. One fingerprint's observations are folded in order of time inside one row.
    """
    start = F.expr("named_struct('status', 'none', 'exceeds', 0L, 'normals', 0L, 'resolved_at', cast(null as bigint), 'opened', false)").cast(STATE)
    series = seen.groupBy("fingerprint", "label_key").agg(F.array_sort(F.collect_list(F.struct(*KEPT))).alias("series"))
    item = series.schema["series"].dataType.elementType.simpleString()
    none = F.array().cast(f"array<struct<o:{item},state:{STATE}>>")

    def stepped(acc: Column, o: Column) -> Column:
        state = _lived(acc["now"], o, rule).cast(STATE)
        return F.struct(state.alias("now"), F.concat(acc["out"], F.array(F.struct(o.alias("o"), state.alias("state")))).alias("out"))

    folded = F.aggregate("series", F.struct(start.alias("now"), none.alias("out")), stepped, lambda acc: acc["out"])
    rows = series.select("fingerprint", "label_key", F.explode(folded).alias("x")).select("fingerprint", "label_key", "x.o.*", "x.state.status", "x.state.opened")
    so_far = Window.partitionBy("fingerprint").orderBy("at")
    begins = F.col("opened") & (F.col("status") != "recurring")
    rows = rows.withColumns({"episode": F.count_if(begins).over(so_far)}).where("episode > 0")
    again = F.count_if(F.col("opened") & (F.col("status") == "recurring")).over(Window.partitionBy("fingerprint", "episode").orderBy("at"))
    return rows.select("fingerprint", "label_key", "episode", "at", F.col("status").alias("transition"), again.alias("recurrences"), F.lit(rule.severity).alias("severity"), "now", "was", "drop")


def kept_findings(occurred: DataFrame) -> DataFrame:
    """fingerprint, label_key, episode, status, severity, first_detected, last_detected, resolved_at, recurrences, superseded: one row for each episode, as of its last observation."""
    by = occurred.groupBy("fingerprint", "label_key", "episode").agg(
        F.max_by("transition", "at").alias("t"), F.max_by("severity", "at").alias("severity"), F.min("at").alias("first_detected"), F.max("at").alias("last_detected"), F.max("recurrences").alias("recurrences")
    )
    last = F.max("episode").over(Window.partitionBy("fingerprint"))
    # An episode that has just begun is stored as active.
    return by.select(
        "fingerprint", "label_key", "episode", F.when(F.col("t") == "new_episode", "active").otherwise(F.col("t")).alias("status"), "severity", "first_detected", "last_detected", F.when(F.col("t") == "resolved", F.col("last_detected")).alias("resolved_at"), "recurrences",
        (F.col("episode") < last).alias("superseded"),
    )


def generated(snapshots: DataFrame, reasons: DataFrame, policy: tuple[Rule, ...]) -> DataFrame:
    """The occurrences that all enabled rules of a policy give over all snapshots."""
    out = None
    for rule in policy:
        if rule.enabled:
            own = occurrences(observations(snapshots, reasons, rule), rule)
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("the policy has no enabled rule")
    return out
