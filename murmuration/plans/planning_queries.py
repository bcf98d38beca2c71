"""Queries of policies over past snapshots, the review plan and the attention list; the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, history, planning, review
from ..operators.findings import Rule
from ..sources import adapters, signals
from ..sources.kept import kept
from .nullable import shown, shown_sql

NEW = (Rule("label_count_drop", "high", 0.2, 5, resolution=1), Rule("reason_distribution_shift", "medium", 0.3, 3))
OLD = (Rule("label_count_drop", "critical", 0.4, 10), Rule("reason_distribution_shift", "low", 0.5, 2))
BEGIN, END = 852_076_800_000, 946_684_800_000  # 1997 to 1999
MONTHLY = Rule("label_count_drop", "high", 0.2, 5, recurrence_ms=180 * findings.DAY_MS, cooldown_ms=30 * findings.DAY_MS)
AT_ONCE = Rule("label_count_drop", "critical", 0.1, 5, resolution=1, recurrence_ms=60 * findings.DAY_MS, cooldown_ms=None, critical_immediate=True)


def _drops(spark, d):
    drops = history.count_drops(history.monthly(adapters.label_history(spark, d)), 5, 0.2)
    return drops.select("label_key", F.unix_millis(F.to_timestamp(F.concat("month", F.lit("-01")), "yyyy-MM-dd")).alias("at"), "missing", "exceeded")


def _states(spark, d, rule):
    states = findings.lifecycle(_drops(spark, d), rule)
    return states.select("label_key", F.date_format(F.timestamp_millis("at"), "yyyy-MM").alias("observed"), "status", "exceeds", "normals", "opened")


def finding_lifecycle(spark, d):
    """Monthly drops of each label, folded into episodes."""
    return _states(spark, d, MONTHLY)


def immediate_lifecycle(spark, d):
    """The same under a rule that opens at once."""
    return _states(spark, d, AT_ONCE)


def backtest(spark, d):
    return findings.backtest(signals.month_snapshots(spark, d), signals.month_reasons(spark, d), NEW, OLD, BEGIN, END)


def shadow_evaluation(spark, d):
    out = findings.shadow(signals.month_snapshots(spark, d), signals.month_reasons(spark, d), NEW)
    return out.withColumn("drop", F.round("drop", 6))


def replayed_episodes(spark, d):
    """Of both policies' rules on dropping counts, over all snapshots."""
    compared = kept(findings.comparisons(signals.month_snapshots(spark, d), signals.month_reasons(spark, d)))
    return findings.replayed(compared, NEW[0], OLD[0])


POLICY = (
    Rule("label_count_drop", "high", 0.3, 5, resolution=1, recurrence_ms=90 * findings.DAY_MS, resolution_threshold=0.1),
    Rule("reason_distribution_shift", "medium", 0.4, 3, activation=1, resolution=2, recurrence_ms=120 * findings.DAY_MS, cooldown_ms=40 * findings.DAY_MS, baseline_window="seven_day", activation_threshold=0.5),
)


def _generated(spark, d):
    day = F.floor(F.col("at") / findings.DAY_MS)
    rows = signals.month_snapshots(spark, d).withColumns({"completeness": F.when(day % 7 == 0, "partial").otherwise("complete"), "crawled": day % 5 != 0})
    return findings.generated(rows, signals.month_reasons(spark, d), POLICY)


def finding_occurrences(spark, d):
    return _generated(spark, d).withColumn("drop", F.round("drop", 6))


def finding_episodes(spark, d):
    return findings.kept_findings(_generated(spark, d))


SEED, BUDGET = "week-31", 60


def review_plan(spark, d):
    labels = adapters.label_history(spark, d)
    newest = kept(history.latest(labels)).withColumns({"confidence": F.col("confidence_milli") / 1000, "evaluable": F.col("account_id").cast("long") % 13 != 0})
    columns = ("label_key", "account_id", "value", "confidence", "reason", "rule_version", "evaluable")
    pool = newest.where(F.col("account_id").cast("long") % 4 != 3).select(*columns)
    changed = newest.select(*columns).join(review.newest_changes(labels, "2001-05-01", "2001-07-31").select("account_id", "label_key", "change_type"), ["account_id", "label_key"])
    populations = newest.groupBy("label_key", "value").agg(F.count("*").alias("n"))
    two = review.top_per_key(signals.month_snapshots(spark, d), ("label_key",), [F.desc("at")], 2).withColumn("share", F.col("true_count") / F.col("evaluated"))
    first = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c)))
    measures = two.groupBy("label_key").agg(first("share", 1).alias("prevalence"), first("share", 2).alias("was_prevalence"), (first("evaluated", 1) / 50).alias("coverage"), (first("evaluated", 2) % 10 / 20).alias("stale"))
    open_ = signals.findings(spark, d).where("status IN ('active', 'recurring') AND id < 40").groupBy("label_key").agg(F.count("*").alias("findings"))
    many = changed.groupBy("label_key").agg(F.count("*").alias("changes"))
    known = measures.join(open_, "label_key", "left").join(many, "label_key", "left").fillna(0, ["findings", "changes"]).withColumn("rule_version", F.lit("1.2.0"))
    plan = planning.review_plan(known, planning.overlaid(pool, changed), populations, SEED, BUDGET)
    return plan.withColumn("signals", F.array_join("signals", ","))


def attention_items(spark, d):
    return planning.attention(signals.issues(spark, d), signals.review_findings(spark, d), signals.occurrences(spark, d))


#: Columns of the results that hold nulls: numbers, verdicts.
NULLS = {
    "review_plan": (("population",), ()),
    "finding_episodes": (("resolved_at",), ()),
    "replayed_episodes": (("new_resolved_at", "old_resolved_at"), ()),
}
QUERIES = {f.__name__: f for f in (finding_lifecycle, immediate_lifecycle, backtest, shadow_evaluation, replayed_episodes, finding_occurrences, finding_episodes, review_plan, attention_items)}
QUERIES |= {name: (lambda spark, d, name=name, f=QUERIES[name]: shown(f(spark, d), *NULLS[name])) for name in NULLS}

# One observation after the other, numbered by time; {act}, {res}, {cool} and {again} are a rule's.
_FOLD = """f{s} AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS at_ms, 'none' AS status, 0::BIGINT AS e, 0::BIGINT AS m, NULL::BIGINT AS r, false AS opened FROM (SELECT DISTINCT k FROM o{s})
 UNION ALL SELECT k, n, at_ms, CASE WHEN missing THEN status WHEN open AND NOT exceeded AND m + 1 >= {res} THEN 'resolved' WHEN opens THEN (CASE WHEN status = 'none' THEN 'active' WHEN r IS NOT NULL AND at_ms - r <= {again} THEN 'recurring' ELSE 'new_episode' END) ELSE status END,
  CASE WHEN missing THEN e WHEN open THEN (CASE WHEN NOT exceeded AND m + 1 >= {res} THEN 0 ELSE e END) WHEN exceeded THEN e + 1 ELSE 0 END, CASE WHEN missing THEN m WHEN exceeded THEN 0 WHEN open THEN m + 1 ELSE m END,
  CASE WHEN missing THEN r WHEN opens THEN NULL WHEN open AND NOT exceeded AND m + 1 >= {res} THEN at_ms ELSE r END, opens AND NOT missing
 FROM (SELECT o.k, o.n, o.at_ms, o.missing, o.exceeded, p.status, p.e, p.m, p.r, p.status IN ('active', 'recurring', 'new_episode') AS open,
  p.status IN ('none', 'resolved') AND o.exceeded AND p.e + 1 >= {act} AND NOT (p.r IS NOT NULL AND o.at_ms - p.r < {cool}) AS opens FROM f{s} p JOIN o{s} o ON o.k = p.k AND o.n = p.n + 1))"""
_DAY = 86_400_000
_SNAPSHOTS = """s AS (SELECT o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m') AS id, o_orderpriority AS label_key, CAST(epoch_ms(date_trunc('month', o_orderdate)) AS BIGINT) AS at_ms, count(*) AS evaluated, count(*) FILTER (o_orderstatus = 'F') AS true_count FROM orders GROUP BY ALL),
 d AS (SELECT o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m') AS id, 'reason-' || (o_orderkey % 3) AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"""
_REASONS = """g AS (SELECT p.id, label_key, reason FROM p JOIN d ON d.id = p.id {first} UNION SELECT p.id, label_key, reason FROM p JOIN d ON d.id = p.b),
 q AS (SELECT g.*, coalesce(y.n, 0) AS now, coalesce(x.n, 0) AS was FROM g JOIN p ON p.id = g.id LEFT JOIN d y ON y.id = p.id AND y.reason = g.reason LEFT JOIN d x ON x.id = p.b AND x.reason = g.reason)"""
_PAIRS = "p AS (SELECT *, lag(id) OVER w AS b, lag(true_count) OVER w AS was, lag(evaluated) OVER w AS was_e FROM s {where} WINDOW w AS (PARTITION BY label_key ORDER BY at_ms))"
_DROP = "CASE WHEN was = 0 THEN 0 ELSE (was - {now}) / was END"


def _episodes(s: str, least: int, most: float, act: int, res: int) -> str:
    """Episodes of a rule on dropping counts, over the pairs p."""
    return f"""o{s} AS (SELECT 'label_count_drop+label:' || label_key AS k, row_number() OVER (PARTITION BY label_key ORDER BY at_ms) AS n, at_ms, evaluated < {least} OR was_e < {least} AS missing, NOT (evaluated < {least} OR was_e < {least}) AND {_DROP.format(now="true_count")} >= {most}::DOUBLE AS exceeded FROM p WHERE b IS NOT NULL),
 {_FOLD.format(s=s, act=act, res=res, cool=3_600_000, again=30 * _DAY)}, e{s} AS (SELECT *, count(*) FILTER (opened) OVER (PARTITION BY k ORDER BY n) AS no FROM f{s}), z{s} AS (SELECT k, min(at_ms) AS opened_at, arg_min(status, n) AS kind, max(r) AS resolved_at FROM e{s} WHERE no > 0 GROUP BY k, no)"""


def _lived(s: str, act: int, res: int, cool: int, again: int, above: float, under: float) -> str:
    """Observations o{s} (k, n, at_ms, missing, drop, ...) one after the other; the bound is lower or higher while a finding is open."""
    fold = _FOLD.format(s=s, act=act, res=res, cool=cool, again=again)
    fold = fold.replace("o.missing, o.exceeded, p.status", f"o.missing, NOT o.missing AND o.drop >= CASE WHEN p.status IN ('active', 'recurring', 'new_episode') THEN {under}::DOUBLE ELSE {above}::DOUBLE END AS exceeded, p.status")
    fold = fold.replace("p.status IN ('none', 'resolved') AND o.exceeded AND", f"p.status IN ('none', 'resolved') AND NOT o.missing AND o.drop >= {above}::DOUBLE AND")
    # A look that leaves a finding resolved is its resolution.
    return fold.replace("CASE WHEN missing THEN r WHEN opens THEN NULL", "CASE WHEN missing THEN (CASE WHEN status = 'resolved' THEN at_ms ELSE r END) WHEN opens THEN NULL WHEN status = 'resolved' THEN at_ms")


_GENERATED = f"""{{snapshots}}, m AS (SELECT *, CASE WHEN at_ms // {_DAY} % 7 = 0 THEN 'partial' ELSE 'complete' END AS completeness, at_ms // {_DAY} % 5 <> 0 AS crawled FROM s),
 c AS (SELECT *, at_ms - {7 * _DAY} AS early FROM m WHERE completeness = 'complete'), b AS (SELECT * FROM c WHERE crawled),
 p1 AS (SELECT c.*, b.id AS bid, coalesce(b.true_count, 0) AS was, coalesce(b.evaluated, 0) AS was_e FROM c ASOF LEFT JOIN b ON c.label_key = b.label_key AND c.at_ms > b.at_ms),
 p2 AS (SELECT c.id, c.label_key, c.at_ms, b.id AS bid FROM c ASOF LEFT JOIN b ON c.label_key = b.label_key AND c.early > b.at_ms),
 o1 AS (SELECT 'label_count_drop+label:' || label_key AS k, label_key, row_number() OVER (PARTITION BY label_key ORDER BY at_ms) AS n, at_ms, evaluated < 5 OR was_e < 5 AS missing, CASE WHEN was = 0 THEN 0 ELSE (was - true_count) / was END AS drop, true_count AS now, was FROM p1),
 w AS (SELECT p2.label_key, p2.at_ms, d.reason, d.n AS was, coalesce(x.n, 0) AS now FROM p2 JOIN d ON d.id = p2.bid LEFT JOIN d x ON x.id = p2.id AND x.reason = d.reason WHERE d.n >= 3),
 o2 AS (SELECT 'reason_distribution_shift+label:' || label_key || '+reason:' || reason AS k, label_key, row_number() OVER (PARTITION BY label_key, reason ORDER BY at_ms) AS n, at_ms, false AS missing, (was - now) / was AS drop, now, was FROM w),
 {{f1}}, {{f2}}, g AS (SELECT o.k, label_key, o.n, o.at_ms, now, was, drop, status, opened, 'high' AS severity FROM f1 f JOIN o1 o ON o.k = f.k AND o.n = f.n UNION ALL SELECT o.k, label_key, o.n, o.at_ms, now, was, drop, status, opened, 'medium' FROM f2 f JOIN o2 o ON o.k = f.k AND o.n = f.n),
 h AS (SELECT *, count(*) FILTER (opened AND status <> 'recurring') OVER (PARTITION BY k ORDER BY n) AS episode FROM g), i AS (SELECT *, count(*) FILTER (opened AND status = 'recurring') OVER (PARTITION BY k, episode ORDER BY n) AS recurrences FROM h WHERE episode > 0)"""


def sql(count_drops: str) -> dict[str, str]:
    """The queries in SQL; `count_drops` is that of the monthly drops."""
    drops = f"o AS (SELECT label_key AS k, row_number() OVER (PARTITION BY label_key ORDER BY month) AS n, CAST(epoch_ms(CAST(month || '-01' AS TIMESTAMP)) AS BIGINT) AS at_ms, missing, exceeded FROM ({count_drops}))"
    states = "SELECT k AS label_key, strftime(make_timestamp(at_ms * 1000), '%Y-%m') AS observed, status, e AS exceeds, m AS normals, opened FROM f WHERE n > 0"
    least = "CASE WHEN {0} THEN 'new_in_candidate' ELSE 'missing_in_candidate' END"
    new = f"(evaluated >= 5 AND was_e >= 5 AND {_DROP.format(now='true_count')} >= 0.2::DOUBLE)"
    old = f"(evaluated >= 10 AND was_e >= 10 AND {_DROP.format(now='true_count')} >= 0.4::DOUBLE)"
    rank = "sha256('week-31' || chr(0) || {0})"
    lived = "WITH RECURSIVE " + _GENERATED.format(snapshots=_SNAPSHOTS, f1=_lived("1", 2, 1, 3_600_000, 90 * _DAY, 0.3, 0.1), f2=_lived("2", 1, 2, 40 * _DAY, 120 * _DAY, 0.5, 0.4))
    found = {
        "finding_occurrences": f"{lived} SELECT k AS fingerprint, label_key, episode, at_ms AS at, status AS transition, recurrences, severity, now, was, round(drop, 6) AS drop FROM i",
        "finding_episodes": f"""{lived}, e AS (SELECT k AS fingerprint, label_key, episode, arg_max(status, n) AS t, any_value(severity) AS severity, min(at_ms) AS first_detected, max(at_ms) AS last_detected, max(recurrences) AS recurrences FROM i GROUP BY ALL)
 SELECT fingerprint, label_key, episode, CASE WHEN t = 'new_episode' THEN 'active' ELSE t END AS status, severity, first_detected, last_detected, CASE WHEN t = 'resolved' THEN last_detected END AS resolved_at, recurrences, episode < max(episode) OVER (PARTITION BY fingerprint) AS superseded FROM e""",
        "finding_lifecycle": f"WITH RECURSIVE {drops}, {_FOLD.format(s='', act=2, res=2, cool=30 * _DAY, again=180 * _DAY)} {states}",
        "immediate_lifecycle": f"WITH RECURSIVE {drops}, {_FOLD.format(s='', act=1, res=1, cool=0, again=60 * _DAY)} {states}",
        "backtest": f"""WITH {_SNAPSHOTS}, {_PAIRS.format(where=f"WHERE at_ms BETWEEN {BEGIN} AND {END}")}, {_REASONS.format(first="WHERE p.b IS NOT NULL")}
 SELECT id AS snapshot_id, 'label_count_drop+label:' || label_key AS fingerprint, CASE WHEN {new} THEN 'high' ELSE 'critical' END AS severity, {least.format(new)} AS diff_kind FROM p WHERE b IS NOT NULL AND {new} <> {old}
 UNION ALL SELECT id, 'reason_distribution_shift+label:' || label_key || '+reason:' || reason, CASE WHEN x THEN 'medium' ELSE 'low' END, {least.format("x")} FROM (SELECT *, was >= 3 AND (was - now) / was >= 0.3::DOUBLE AS x, was >= 2 AND (was - now) / was >= 0.5::DOUBLE AS y FROM q) WHERE x <> y""",
        "shadow_evaluation": f"""WITH {_SNAPSHOTS}, {_PAIRS.format(where="")}, {_REASONS.format(first="")}, v AS (SELECT id, label_key, evaluated < 5 OR coalesce(was_e, 0) < 5 AS missing, true_count, coalesce(was, 0) AS was FROM p)
 SELECT id AS snapshot_id, 'label_count_drop+label:' || label_key AS fingerprint, missing, true_count AS observed, was AS baseline, round({_DROP.format(now="true_count")}, 6) AS drop, NOT missing AND {_DROP.format(now="true_count")} >= 0.2::DOUBLE AS exceeded FROM v
 UNION ALL SELECT id, 'reason_distribution_shift+label:' || label_key || '+reason:' || reason, false, now, was, round((was - now) / was, 6), (was - now) / was >= 0.3::DOUBLE FROM q WHERE was >= 3""",
        "replayed_episodes": f"""WITH RECURSIVE {_SNAPSHOTS}, {_PAIRS.format(where="")}, {_episodes("1", 5, 0.2, 2, 1)}, {_episodes("2", 10, 0.4, 2, 2)}
 SELECT k AS fingerprint, opened_at, a.kind AS new_kind, a.resolved_at AS new_resolved_at, b.kind AS old_kind, b.resolved_at AS old_resolved_at,
 CASE WHEN b.kind IS NULL THEN 'new' WHEN a.kind IS NULL THEN 'gone' WHEN a.kind = b.kind AND a.resolved_at IS NOT DISTINCT FROM b.resolved_at THEN 'same' ELSE 'changed' END AS diff FROM z1 a FULL JOIN z2 b USING (k, opened_at)""",
        "review_plan": f"""WITH {_SNAPSHOTS}, h AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS account_id, o_orderpriority AS label_key, o_orderstatus = 'F' AS value, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 1001 AS milli, 'reason-' || (o_orderkey % 7) AS reason, '1.' || (o_orderkey % 3) || '.0' AS rule_version, o_orderdate AS dt FROM orders),
 g AS (SELECT *, lag(value) OVER w AS v0, lag(rule_version) OVER w AS ver0, lag(milli) OVER w AS m0, lag(reason) OVER w AS r0, row_number() OVER (PARTITION BY account_id, label_key ORDER BY dt DESC, id DESC) AS k FROM h WINDOW w AS (PARTITION BY account_id, label_key ORDER BY dt, id)),
 n AS (SELECT account_id, label_key, value, milli / 1000 AS confidence, reason, rule_version, CAST(account_id AS BIGINT) % 13 <> 0 AS evaluable FROM g WHERE k = 1),
 c AS (SELECT account_id, label_key, arg_max(change_type, (dt, id)) AS change_type FROM ({{changes}}) WHERE dt BETWEEN TIMESTAMP '2001-05-01' AND TIMESTAMP '2001-07-31' GROUP BY ALL),
 x AS (SELECT n.*, c.change_type FROM n LEFT JOIN c USING (account_id, label_key) WHERE CAST(account_id AS BIGINT) % 4 <> 3 OR c.change_type IS NOT NULL),
 t AS (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY at_ms DESC) AS place FROM s),
 l AS (SELECT label_key, max(true_count / evaluated) FILTER (place = 1) AS a, max(true_count / evaluated) FILTER (place = 2) AS b, max(evaluated) FILTER (place = 1) / 50 AS coverage, max(evaluated) FILTER (place = 2) % 10 / 20 AS stale FROM t GROUP BY 1),
 o AS (SELECT (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[p_partkey % 5 + 1] AS label_key, count(*) AS findings FROM part WHERE p_partkey < 40 AND p_partkey % 5 <> 4 AND p_partkey // 5 % 4 IN (0, 2) GROUP BY 1),
 y AS (SELECT label_key, count(*) AS changes FROM c GROUP BY 1), w AS (SELECT *, CASE WHEN b = 0 THEN (CASE WHEN a = 0 THEN 0 ELSE 1 END) ELSE abs(a - b) / abs(b) END AS shift FROM l),
 r AS (SELECT label_key, round(1 + least(4, coalesce(findings, 0) * 2) + CASE WHEN coalesce(changes, 0) > 0 THEN least(3, log2(changes + 1)) ELSE 0 END + CASE WHEN shift >= 0.3 THEN 3 WHEN shift >= 0.1 THEN 1 ELSE 0 END + CASE WHEN coverage < 0.8 THEN 2 ELSE 0 END + CASE WHEN stale > 0.1 THEN 2 ELSE 0 END, 3) AS risk,
  {rank.format("label_key || ':baseline-order'")} AS turn FROM w LEFT JOIN o USING (label_key) LEFT JOIN y USING (label_key)),
 e AS (SELECT x.*, label_key || ':' || account_id AS sample_id, risk, turn, count(*) OVER (PARTITION BY label_key, reason) AS same FROM x JOIN r USING (label_key)),
 u AS (SELECT *, list_filter([CASE WHEN NOT evaluable THEN 'insufficient_support' END, CASE WHEN change_type IS NOT NULL THEN 'recent_change' END, CASE WHEN rule_version <> '1.2.0' THEN 'old_rule_version' END, CASE WHEN NOT value AND confidence < 0.9 THEN 'positive_evidence_negative' END,
  CASE WHEN value AND confidence < 0.5 THEN 'low_confidence_positive' END, CASE WHEN same <= 2 THEN 'rare_reason' END], lambda z: z IS NOT NULL) AS signals FROM e),
 v AS (SELECT *, coalesce(signals[1], 'risk_targeted') AS kind, round(risk + CASE coalesce(signals[1], '') WHEN 'insufficient_support' THEN 9 WHEN 'recent_change' THEN 8 WHEN 'old_rule_version' THEN 6 WHEN 'positive_evidence_negative' THEN 5 + (0.9 - confidence) * 3 WHEN 'low_confidence_positive' THEN 5 + (0.5 - confidence) * 3 WHEN 'rare_reason' THEN 2 ELSE 0 END, 3) AS priority FROM u),
 b AS (SELECT *, row_number() OVER (PARTITION BY label_key, value ORDER BY {rank.format("sample_id || ':baseline'")}) AS first FROM v WHERE evaluable AND change_type IS NULL QUALIFY first = 1), pc AS (SELECT label_key, value, count(*) AS population FROM n GROUP BY ALL),
 m AS (SELECT sample_id, account_id, label_key, value, CASE WHEN value THEN 'random_positive' ELSE 'random_negative' END AS sample_kind, 0::DOUBLE AS priority, signals, population, 0 AS stage, turn AS rank FROM b JOIN pc USING (label_key, value)
  UNION ALL SELECT sample_id, account_id, label_key, value, kind, priority, signals, NULL, 1, {rank.format("sample_id || ':' || kind")} FROM v WHERE sample_id NOT IN (SELECT sample_id FROM b))
 SELECT sample_id, account_id, label_key, value, sample_kind, CAST(priority AS DOUBLE) AS priority, array_to_string(signals, ',') AS signals, population FROM m ORDER BY stage, priority DESC, rank, value DESC LIMIT 60""".replace("{changes}", "SELECT * FROM (SELECT account_id, label_key, id, dt, CASE WHEN v0 IS NULL THEN (CASE WHEN value THEN 'added' END) WHEN value AND NOT v0 THEN 'added' WHEN NOT value AND v0 THEN 'removed' WHEN milli <> m0 OR reason <> r0 THEN 'updated' END AS change_type FROM g) WHERE change_type IS NOT NULL"),
        "attention_items": """WITH i AS (SELECT 'operational_issue' AS source_type, CAST(s_suppkey AS VARCHAR) AS source_id, (['crawl_stalled', 'outbox_stalled'])[s_suppkey % 2 + 1] AS category, CASE WHEN s_suppkey % 37 = 0 THEN 'critical' ELSE (['low', 'high', 'medium', 'odd', 'low'])[s_suppkey % 5 + 1] END AS severity, false AS recurring, 0::DOUBLE AS share, 0 AS affected, 0 AS total,
  s_suppkey * 7919 % 1000 * 1000 AS detected_at, (['crawler', 'blocker'])[s_suppkey % 2 + 1] || ': ' || (['crawl_stalled', 'outbox_stalled'])[s_suppkey % 2 + 1] AS summary, '/operations/issues/' || s_suppkey AS detail FROM supplier WHERE s_suppkey % 3 <> 1),
 o AS (SELECT l_partkey AS k, arg_max({'a': CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_quantity AS BIGINT) END, 't': CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS BIGINT) + l_orderkey % 5 ELSE 0 END}, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS o FROM lineitem GROUP BY 1),
 f AS (SELECT 'review_finding' AS source_type, CAST(p_partkey AS VARCHAR) AS source_id, (['label_count_drop', 'coverage_gap', 'reason_distribution_shift'])[p_partkey % 3 + 1] AS category, CASE WHEN p_partkey % 401 = 7 THEN 'critical' ELSE (['low', 'medium', 'high', 'odd'])[p_partkey % 4 + 1] END AS severity,
  p_partkey % 5 IN (1, 4) AS recurring, CASE WHEN coalesce(o.t, 0) > 0 THEN coalesce(o.a, 0) / o.t ELSE 0 END AS share, coalesce(o.a, 0) AS affected, coalesce(o.t, 0) AS total, p_partkey * 104729 % 1000 * 1000 AS detected_at,
  (['label_count_drop', 'coverage_gap', 'reason_distribution_shift'])[p_partkey % 3 + 1] || ' (label:' || (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[p_partkey % 5 + 1] || ')' AS summary, '/review/findings/' || p_partkey AS detail FROM part LEFT JOIN o ON o.k = p_partkey WHERE p_partkey % 5 <> 2)
 SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, recurring DESC, share DESC, affected DESC, detected_at, source_type, source_id) AS INTEGER) AS priority, source_type, source_id, category, severity, summary, affected, total, detected_at, detail
 FROM (SELECT * FROM i UNION ALL SELECT * FROM f) WHERE severity <> 'odd' ORDER BY priority LIMIT 8""",
    }
    return found | {name: shown_sql(found[name], *NULLS[name]) for name in NULLS}
