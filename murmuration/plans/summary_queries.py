"""Queries of summaries: label summaries by as-of joins, account summaries by groups of columns, and counts that a stream keeps up; the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import asof, upserts
from ..sources import adapters, signals
from ..sources.kept import shared_folder
from ..streaming import counts, generations
from .nullable import shown, shown_sql


def label_summary(spark, d):
    """Of each label's last snapshot of a month."""
    rows = signals.snapshots(spark, d)
    month = F.date_format(F.date_from_unix_date("day"), "yyyy-MM")
    current = rows.groupBy("label_key", month.alias("m")).agg(F.max_by(F.struct("id", "at", "evaluated", "true_count", "completeness"), "at").alias("r")).select("label_key", "r.*")
    out = asof.label_summary(current, rows, signals.findings(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c == "prevalence" or c.endswith("_delta") else F.col(c) for c in out.columns])


def baselines(spark, d):
    """Each snapshot with the last one strictly before it, whatever its completeness, if it isn't older than five days."""
    rows = signals.snapshots(spark, d)
    found = asof.as_of(rows, rows, ["label_key"], order=("id",), strict=True, tolerance=5 * asof.DAY_MS, stretch=10 * asof.DAY_MS)
    return found.select("id", F.col("found.id").alias("baseline"), (F.col("true_count") - F.col("found.true_count")).alias("change"))


def summary_merge(spark, d):
    return upserts.by_group(signals.stored_summaries(spark, d), signals.new_summaries(spark, d), "account_id", signals.SUMMARY_GROUPS, "seq")


STREAM_FILES = 3


def streamed_counts(spark, d):
    """The whole label history as a stream of some batches, dealt by hash, so that many rows come late; the counts that it leaves."""
    history = adapters.label_history(spark, d)
    rows = history.select("account_id", "label_key", "value", "confidence_milli", "rule_version", "reason", F.unix_micros(F.col("labeled_at").cast("timestamp")).alias("labeled_us"), "id")
    folder = f"{shared_folder(rows)}/stream-{uuid.uuid4().hex[:12]}"
    rows.repartition(STREAM_FILES, F.xxhash64("id")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counts.keep_counts(stream, f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return generations.newest(spark, f"{folder}/out", "label_key string, kind string, name string, n long, milli long")


#: Columns of the results that hold nulls: numbers, verdicts.
NULLS = {
    "baselines": (("change",), ()),
    "summary_merge": (("labels_at", "findings_at"), ()),
}
QUERIES = {f.__name__: f for f in (label_summary, baselines, summary_merge, streamed_counts)}
QUERIES |= {name: (lambda spark, d, name=name, f=QUERIES[name]: shown(f(spark, d), *NULLS[name])) for name in NULLS}

_SNAPSHOTS = """s AS (SELECT label_key || '|' || day AS id, label_key, day, day * 86400000 + day % 5 * 3600000 AS at_ms, evaluated, true_count, CASE WHEN day % 7 = 0 THEN 'partial' WHEN day % 11 = 0 THEN 'unknown' ELSE 'complete' END AS completeness
 FROM (SELECT o_orderpriority AS label_key, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) // 86400 AS day, count(*) AS evaluated, count(*) FILTER (o_orderstatus = 'F') AS true_count FROM orders GROUP BY 1, 2))"""
_THEN = "CASE WHEN {0}.evaluated = 0 THEN 0 ELSE {0}.true_count / {0}.evaluated END"
_SUMS = {"profile_at": ["screen_name"], "labels_at": ["labels", "label_count"], "findings_at": ["finding_count", "severity"]}
_ROW = """CAST({key} AS VARCHAR) AS account_id, '{p}' || {n} AS screen_name, {n} % {a} AS profile_at, '{p}k' || ({n} % 3) AS labels, {n} % 6 AS label_count, CASE WHEN {n} % {g} <> 0 THEN {n} % {b} END AS labels_at,
 {n} % 5 AS finding_count, '{p}s' || ({n} % 4) AS severity, CASE WHEN {n} % {h} <> 0 THEN {n} % {c} END AS findings_at"""
_BEST = "t{0} AS (SELECT account_id, {1}, {0} FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY {0} DESC NULLS LAST, seq DESC) AS k FROM u) WHERE k = 1)"
_LAST = """h AS (SELECT o_orderpriority AS label_key, o_orderstatus = 'F' AS value, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 1001 AS milli, '1.' || (o_orderkey % 3) || '.0' AS version, 'reason-' || (o_orderkey % 7) AS reason, epoch_us(o_orderdate) // 60000000 AS minute,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS k FROM orders)"""

ORACLE_SQL = {
    "label_summary": f"""WITH {_SNAPSHOTS}, c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label_key, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m') ORDER BY at_ms DESC) = 1), k AS (SELECT * FROM s WHERE completeness = 'complete'),
 n AS (SELECT id, at_ms - 1 AS t1, at_ms - 86400000 AS t2, at_ms - 604800000 AS t3, label_key FROM c WHERE completeness = 'complete'),
 d1 AS (SELECT n.id, {_THEN.format("k")} AS v FROM n ASOF JOIN k ON n.label_key = k.label_key AND n.t1 >= k.at_ms), d2 AS (SELECT n.id, {_THEN.format("k")} AS v FROM n ASOF JOIN k ON n.label_key = k.label_key AND n.t2 >= k.at_ms),
 d3 AS (SELECT n.id, {_THEN.format("k")} AS v FROM n ASOF JOIN k ON n.label_key = k.label_key AND n.t3 >= k.at_ms),
 f AS (SELECT p_partkey AS id, (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[p_partkey % 5 + 1] AS label_key, CASE WHEN p_partkey % 5 = 4 THEN 'resolved' ELSE (['active', 'dismissed', 'recurring', 'resolved'])[p_partkey // 5 % 4 + 1] END AS status,
  (['odd', 'low', 'medium', 'high'])[p_partkey // 5 % (p_partkey % 5 + 1) % 4 + 1] AS severity FROM part),
 a AS (SELECT label_key, count(*) AS n, arg_min(severity, (CASE severity WHEN 'critical' THEN -3 WHEN 'high' THEN -2 WHEN 'medium' THEN -1 ELSE 0 END, id)) AS top FROM f WHERE status IN ('active', 'recurring') GROUP BY 1)
 SELECT c.id, c.label_key, at_ms AS at, evaluated, true_count, round({_THEN.format("c")}, 6) AS prevalence, round({_THEN.format("c")} - d1.v, 6) AS previous_delta, round({_THEN.format("c")} - d2.v, 6) AS day_delta, round({_THEN.format("c")} - d3.v, 6) AS week_delta,
 coalesce(a.n, 0) AS active_findings, top AS highest_severity, CASE completeness WHEN 'unknown' THEN 'unknown' WHEN 'partial' THEN 'watch' ELSE CASE WHEN a.n > 0 THEN 'attention' ELSE 'normal' END END AS quality
 FROM c LEFT JOIN d1 USING (id) LEFT JOIN d2 USING (id) LEFT JOIN d3 USING (id) LEFT JOIN a ON a.label_key = c.label_key""",
    "baselines": f"""WITH {_SNAPSHOTS} SELECT s.id, CASE WHEN s.at_ms - b.at_ms <= 432000000 THEN b.id END AS baseline, CASE WHEN s.at_ms - b.at_ms <= 432000000 THEN s.true_count - b.true_count END AS change FROM s ASOF LEFT JOIN s b ON s.label_key = b.label_key AND s.at_ms > b.at_ms""",
    "summary_merge": f"""WITH u AS (SELECT -1 AS seq, {_ROW.format(key="c_custkey", n="c_custkey", p="s", a=50, b=60, c=40, g=7, h=3)} FROM customer UNION ALL SELECT o_orderkey, {_ROW.format(key="o_custkey", n="o_orderkey", p="n", a=100, b=90, c=70, g=5, h=4)} FROM orders),
 {", ".join(_BEST.format(at, ", ".join(own)) for at, own in _SUMS.items())} SELECT * FROM tprofile_at JOIN tlabels_at USING (account_id) JOIN tfindings_at USING (account_id)""",
    "streamed_counts": f"""WITH {_LAST}, l AS (SELECT * FROM h WHERE k = 1) SELECT label_key, 'value' AS kind, CAST(value AS VARCHAR) AS name, count(*) AS n, CAST(sum(milli) AS BIGINT) AS milli FROM l GROUP BY 1, 3
 UNION ALL SELECT label_key, 'decile', CAST(least(milli // 100, 9) AS VARCHAR), count(*), 0 FROM l GROUP BY 1, 3 UNION ALL SELECT label_key, 'version', version, count(*), 0 FROM l GROUP BY 1, 3
 UNION ALL SELECT label_key, 'minute', CAST(minute AS VARCHAR), count(*), 0 FROM l GROUP BY 1, 3 UNION ALL SELECT label_key, 'reason', reason, count(*), 0 FROM l WHERE value GROUP BY 1, 3""",
}
ORACLE_SQL |= {name: shown_sql(ORACLE_SQL[name], *NULLS[name]) for name in NULLS}
