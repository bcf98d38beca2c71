"""What people should look at next: the weekly review plan and the attention list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed
from .asof import SEVERITIES, severity_place
from .review import relative_delta, risk_score, stable_rank

# Fixed values of the plan: evidence of a negative, of a positive, and how rare a reason is.
NEGATIVE_EVIDENCE, POSITIVE_EVIDENCE, RARE = 0.9, 0.5, 2
ATTENTION_ITEMS = 8


def overlaid(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """Candidates (label_key, account_id, ...) with the change_type of `changes`, which gives nothing else where both have a row; changes without a candidate are candidates too."""
    rest = [c for c in candidates.columns if c not in ("label_key", "account_id", "change_type")]
    c, x = candidates.withColumn("__c", F.struct(*rest)).select("label_key", "account_id", "__c"), changes.withColumn("__x", F.struct(*rest)).select("label_key", "account_id", "change_type", "__x")
    return c.join(x, ["label_key", "account_id"], "full_outer").select("label_key", "account_id", F.coalesce("__c", "__x").alias("r"), "change_type").select("label_key", "account_id", "r.*", "change_type")


def review_plan(labels: DataFrame, candidates: DataFrame, populations: DataFrame, seed: str, budget: int) -> DataFrame:
    """sample_id, account_id, label_key, value, sample_kind, priority, signals and population: at most `budget` candidates to review.

    First one positive and one negative of each label, chosen by a seeded hash among the evaluable ones without a change, labels in an order of their own hash; what is
    left of the budget goes to the others by priority, then by hash. Labels: label_key, rule_version, findings, changes, prevalence, was_prevalence,
    coverage, stale (null measures add nothing to the risk); candidates: label_key, account_id, value, confidence, reason, rule_version, evaluable, change_type;
    populations: label_key, value, n. Each stratum's first is an aggregate and the rest a top-k, so no task sees all candidates.
    """
    shift = relative_delta(F.col("prevalence"), F.col("was_prevalence"))
    both = F.col("prevalence").isNotNull() & F.col("was_prevalence").isNotNull()
    risk = risk_score(F.col("findings"), F.col("changes"), F.when(both, shift).otherwise(0.0), F.coalesce("coverage", F.lit(1.0)), F.coalesce("stale", F.lit(0.0)))
    known = labels.select("label_key", F.col("rule_version").alias("current"), risk.alias("risk"), stable_rank(seed, F.concat("label_key", F.lit(":baseline-order"))).alias("turn"))
    common = candidates.groupBy("label_key", "reason").agg(F.count("*").alias("same_reason"))
    sample = F.concat_ws(":", "label_key", "account_id")
    rows = candidates.join(known, "label_key").join(common.where(F.col("same_reason") > RARE), ["label_key", "reason"], "left")
    signals = {
        "insufficient_support": ~F.col("evaluable"), "recent_change": F.col("change_type").isNotNull(), "old_rule_version": F.col("rule_version") != F.col("current"),
        "positive_evidence_negative": ~F.col("value") & (F.col("confidence") < NEGATIVE_EVIDENCE), "low_confidence_positive": F.col("value") & (F.col("confidence") < POSITIVE_EVIDENCE), "rare_reason": F.col("same_reason").isNull(),
    }
    extra = {
        "insufficient_support": F.lit(9.0), "recent_change": F.lit(8.0), "old_rule_version": F.lit(6.0), "positive_evidence_negative": 5 + (NEGATIVE_EVIDENCE - F.col("confidence")) * 3,
        "low_confidence_positive": 5 + (POSITIVE_EVIDENCE - F.col("confidence")) * 3, "rare_reason": F.lit(2.0),
    }
    kind, more = F.lit("risk_targeted"), F.lit(0.0)
    for name, holds in reversed(signals.items()):
        kind, more = F.when(holds, name).otherwise(kind), F.when(holds, extra[name]).otherwise(more)
    told = F.array_compact(F.array(*[F.when(holds, name) for name, holds in signals.items()]))
    rows = rows.select("label_key", "account_id", "value", "turn", sample.alias("sample_id"), (F.col("evaluable") & F.col("change_type").isNull()).alias("plain"), kind.alias("kind"), fixed(F.col("risk") + more, 3).cast("double").alias("priority"), told.alias("signals"))
    baseline_rank = stable_rank(seed, F.concat("label_key", F.lit(":"), "account_id", F.lit(":baseline")))
    first = rows.where("plain").groupBy("label_key", "value").agg(F.min_by(F.struct("account_id", "sample_id", "signals", "turn"), F.struct(baseline_rank, "account_id")).alias("r"))
    first = first.select("label_key", "value", "r.*").orderBy("turn", F.desc("value")).limit(budget)
    random = first.join(populations, ["label_key", "value"], "left").select(
        "sample_id", "account_id", "label_key", "value", F.when(F.col("value"), "random_positive").otherwise("random_negative").alias("sample_kind"), F.lit(0.0).alias("priority"), "signals", F.col("n").alias("population"), F.lit(0).alias("place"), F.col("turn").alias("rank")
    )
    others = rows.join(F.broadcast(first.select("sample_id")), "sample_id", "left_anti")  # `budget` ids at most
    targeted = others.select("sample_id", "account_id", "label_key", "value", F.col("kind").alias("sample_kind"), "priority", "signals", F.lit(None).cast("long").alias("population"), F.lit(1).alias("place"), stable_rank(seed, F.concat("sample_id", F.lit(":"), "kind")).alias("rank"))
    best = targeted.orderBy(F.desc("priority"), "rank").limit(budget)
    return random.unionByName(best).orderBy("place", F.desc("priority"), "rank", F.desc("value")).limit(budget).drop("place", "rank")


def attention(issues: DataFrame, findings: DataFrame, occurrences: DataFrame, most: int = ATTENTION_ITEMS) -> DataFrame:
    """priority, source_type, source_id, category, severity, summary, affected, total, detected_at, detail: what is open, from the worst on.

    Issues (id, type, status, severity, component, detected_at) that are active and findings (id, type, status, severity, scope_type, scope_id, detected_at) that are active or
    recurring, by severity, recurring ones first, then by the affected share and number of a finding's latest occurrence (id, finding_id, observed_at, affected, total), then the oldest; issues before findings, then by id.
    Lower severities are left out before occurrences are looked up, as soon as those above have rows enough.
    """
    rank = severity_place(F.col("severity")).alias("rank")
    named = F.col("severity").isin(*SEVERITIES)
    i = issues.where((F.col("status") == "active") & named).select("*", rank)
    f = findings.where(F.col("status").isin("active", "recurring") & named).select("*", rank)
    tiers = i.select("rank").unionByName(f.select("rank")).groupBy("rank").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1))  # four rows at most
    wanted = F.broadcast(tiers.select("rank", F.coalesce(above, F.lit(0)).alias("above")).where(F.col("above") < most).select("rank"))
    f = f.join(wanted, "rank", "left_semi")
    latest = occurrences.join(f.select(F.col("id").alias("finding_id")), "finding_id", "left_semi").groupBy("finding_id").agg(F.max_by(F.struct("affected", "total"), F.struct("observed_at", "id")).alias("o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    f = f.join(latest, F.col("id") == F.col("finding_id"), "left")
    found = f.select(
        F.lit("review_finding").alias("source_type"), F.col("id").alias("source_id"), F.col("type").alias("category"), "severity", "rank", (F.col("status") == "recurring").alias("recurring"),
        F.when(zero("o.total") > 0, zero("o.affected") / F.col("o.total")).otherwise(0.0).alias("share"), zero("o.affected").alias("affected"), zero("o.total").alias("total"), "detected_at",
        F.concat("type", F.lit(" ("), "scope_type", F.lit(":"), "scope_id", F.lit(")")).alias("summary"), F.concat(F.lit("/review/findings/"), "id").alias("detail"),
    )
    none = F.lit(0).cast("long")
    open_issues = i.join(wanted, "rank", "left_semi").select(
        F.lit("operational_issue").alias("source_type"), F.col("id").alias("source_id"), F.col("type").alias("category"), "severity", "rank", F.lit(False).alias("recurring"), F.lit(0.0).alias("share"), none.alias("affected"), none.alias("total"), "detected_at",
        F.concat("component", F.lit(": "), "type").alias("summary"), F.concat(F.lit("/operations/issues/"), "id").alias("detail"),
    )
    order: list[Column] = [F.desc("rank"), F.desc("recurring"), F.desc("share"), F.desc("affected"), F.asc("detected_at"), F.asc("source_type"), F.asc("source_id")]
    top = open_issues.unionByName(found).orderBy(*order).limit(most)
    return top.withColumn("priority", F.row_number().over(Window.orderBy(*order))).select("priority", "source_type", "source_id", "category", "severity", "summary", "affected", "total", "detected_at", "detail")
