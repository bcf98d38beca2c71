"""Queries of the read views, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, history, views
from ..sources import adapters, signals
from . import summary_queries
from .nullable import shown, shown_sql

NOW = 996_624_000_000  # 2001-08-01


def label_list(spark, d):
    """The summaries of each label's last snapshots of a month, those of 1998, in the order of the list."""
    rows = summary_queries.label_summary(spark, d).where(F.col("at").between(883_612_800_000, 915_148_799_999))
    return views.label_list(rows.withColumn("label_key", F.col("id"))).select("id", "quality", "active_findings", "prevalence", "place")


def label_heads(spark, d):
    out = views.label_heads(signals.snapshots(spark, d))
    return out.withColumn("prevalence", F.round("prevalence", 6))


def label_trends(spark, d):
    out = views.label_trends(signals.snapshots(spark, d), NOW, 90)
    return out.withColumn("prevalence", F.round("prevalence", 6))


def label_histories(spark, d):
    rows = views.label_histories(adapters.label_history(spark, d), 12, 2)
    return rows.select("account_id", "label_key", "id", "place")


def relation_lists(spark, d):
    """Of each account, whom it follows: the newest three by number, and how many in all."""
    edges = adapters.follow(spark, d).withColumn("seen", F.col("followee_id").cast("long") % 50)
    return views.relations(edges, "follower_id", "followee_id", "seen", 3).withColumn("others", F.array_join("others", ","))


def _findings(spark, d):
    return signals.review_findings(spark, d).withColumnRenamed("detected_at", "last_detected").select("id", "type", "status", "severity", "scope_type", "last_detected")


def findings_page(spark, d):
    """The third page of open findings, by the cursors of those before."""
    rows, told = views.filtered(_findings(spark, d), severity=("low", "critical", "medium"), type="coverage_gap", scope_type="label")
    found, cursor = views.page(rows, views.FINDING_KEYS, 7, None, told)
    for _ in range(2):
        found, cursor = views.page(rows, views.FINDING_KEYS, 7, cursor, told)
    return spark.createDataFrame(found, rows.schema)


def summaries_page(spark, d):
    """Stored summaries by when they were labelled, nulls last: the page behind the last one that was."""
    keys = (views.Key("labels_at", True), views.Key("account_id"))
    rows = signals.stored_summaries(spark, d).select("account_id", "labels_at", "screen_name")
    return rows.where(views.behind(keys, (0, "3"))).orderBy(*[k.order() for k in keys]).limit(40)


def finding_details(spark, d):
    out = views.finding_details(_findings(spark, d), signals.occurrences(spark, d), 3)
    return out.select("id", "status", "occurrence_id", "affected", "total", "place")


def dashboard_kpis(spark, d):
    accounts = adapters.account(spark, d).withColumn("crawled_at", F.col("id").cast("long") % 1000)
    return views.dashboard(accounts, adapters.tweet(spark, d), history.account_summary(adapters.label_history(spark, d)))


def top_labels(spark, d):
    rows = views.label_heads(signals.snapshots(spark, d))
    return views.top_labels(rows, 3).select("label_key", "true_count")


def redacted_errors(spark, d):
    """Raw pages' first lines as an error list would show them."""
    return adapters.table(spark, d, "pages").select("page_id", views.redacted(F.col("html"), 60).alias("shown"), views.search_document(F.col("url"), F.lit("Page")).alias("document"))


def sampled_follow_signals(spark, d):
    """Follow signals where every fourth order line is a sampled followee, some of them not among the live edges."""
    items = adapters.table(spark, d, "lineitem").where("l_orderkey % 4 = 0")
    samples = items.select((F.col("l_suppkey") % 50).cast("string").alias("account_id"), F.col("l_partkey").cast("string").alias("followee_id")).distinct()
    return graph.follow_signals(adapters.follow(spark, d), adapters.label_history(spark, d), samples)


def rule_candidates(spark, d):
    """Whom account 7 would block next by two labels, with blocks, actions and an outbox made of the block table."""
    newest = history.latest(adapters.label_history(spark, d))
    targets = spark.createDataFrame([("1-URGENT", "1.1.0", 200), ("2-HIGH", "1.2.0", 600)], "label_key string, rule_version string, least_milli long")
    relations = adapters.block(spark, d)
    n = F.col("blocked_id").cast("long")
    actions = relations.withColumn("result", F.when(F.col("flag") == "R", "success").otherwise("failed"))
    outbox = relations.select("blocker_id", "blocked_id", signals.pick(("pending_remote", "remote_skipped", "remote_failed", "remote_skipped", "remote_succeeded"), n).alias("status"), F.col("missing_before").alias("skips"), (n % 100).alias("skipped_s"))
    return graph.rule_candidates(newest, targets, "7", adapters.follow(spark, d), relations.where((F.col("status") == "F") & (n % 3 == 0)), actions, outbox, 100, 2, 30, 60)


#: Columns of the results that hold nulls: numbers, verdicts.
NULLS = {
    "finding_details": (("occurrence_id", "affected", "total", "place"), ()),
    "summaries_page": (("labels_at",), ()),
    "label_heads": (("at", "evaluated", "true_count"), ()),
}
QUERIES = {f.__name__: f for f in (label_list, label_heads, label_trends, label_histories, relation_lists, findings_page, summaries_page, finding_details, dashboard_kpis, top_labels, redacted_errors, sampled_follow_signals, rule_candidates)}
QUERIES |= {name: (lambda spark, d, name=name, f=QUERIES[name]: shown(f(spark, d), *NULLS[name])) for name in NULLS}

_S = summary_queries._SNAPSHOTS
_SHARE = "CASE WHEN evaluated = 0 THEN 0 ELSE true_count / evaluated END"
_FINDINGS = """f AS (SELECT CAST(p_partkey AS VARCHAR) AS id, (['label_count_drop', 'coverage_gap', 'reason_distribution_shift'])[p_partkey % 3 + 1] AS type, (['active', 'recurring', 'resolved', 'active', 'recurring'])[p_partkey % 5 + 1] AS status,
 CASE WHEN p_partkey % 401 = 7 THEN 'critical' ELSE (['low', 'medium', 'high', 'odd'])[p_partkey % 4 + 1] END AS severity, 'label' AS scope_type, p_partkey * 104729 % 1000 * 1000 AS last_detected FROM part)"""

ORACLE_SQL = {
    "label_list": f"""SELECT id, quality, active_findings, prevalence, CAST(row_number() OVER (ORDER BY CASE quality WHEN 'watch' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, active_findings = 0, prevalence DESC, id) AS INTEGER) AS place
 FROM ({summary_queries.ORACLE_SQL["label_summary"]}) WHERE "at" BETWEEN 883612800000 AND 915148799999""",
    "label_heads": f"""WITH {_S}, c AS (SELECT * FROM s WHERE completeness = 'complete' QUALIFY row_number() OVER (PARTITION BY label_key ORDER BY at_ms DESC, id DESC) = 1), n AS (SELECT label_key, completeness FROM s QUALIFY row_number() OVER (PARTITION BY label_key ORDER BY at_ms DESC, id DESC) = 1)
 SELECT label_key, id, at_ms AS at, evaluated, true_count, round({_SHARE}, 6) AS prevalence, n.completeness <> 'complete' AS failed FROM n LEFT JOIN c USING (label_key)""",
    "label_trends": f"WITH {_S} SELECT label_key, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day, evaluated, true_count, round({_SHARE}, 6) AS prevalence FROM s WHERE completeness = 'complete' AND at_ms <= {NOW} AND day * 86400000 >= {NOW - 90 * 86_400_000}",
    "label_histories": """WITH h AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS account_id, o_orderpriority AS label_key, o_orderdate AS dt FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY dt DESC, id DESC) AS n FROM h QUALIFY n <= 12),
 p AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id, label_key ORDER BY n) - 1 AS INTEGER) AS place FROM n) SELECT account_id, label_key, id, place FROM p WHERE place BETWEEN 1 AND 2""",
    "relation_lists": """WITH e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS owner, CAST(l_partkey AS VARCHAR) AS x, l_partkey % 50 AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seen DESC, x) AS n FROM e)
 SELECT owner, count(*) AS total, string_agg(x, ',' ORDER BY n) FILTER (n <= 3) AS others FROM n GROUP BY 1""",
    "findings_page": f"""WITH {_FINDINGS}, r AS (SELECT *, CAST(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END AS INTEGER) AS severity_rank FROM f WHERE status IN ('active', 'recurring') AND severity IN ('low', 'critical', 'medium') AND type = 'coverage_gap')
 SELECT * FROM r ORDER BY severity_rank DESC, last_detected DESC, id DESC LIMIT 7 OFFSET 14""",
    "summaries_page": """SELECT CAST(c_custkey AS VARCHAR) AS account_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 60 END AS labels_at, 's' || c_custkey AS screen_name FROM customer WHERE c_custkey % 7 = 0 OR (c_custkey % 60 = 0 AND CAST(c_custkey AS VARCHAR) > '3') ORDER BY labels_at DESC NULLS LAST, account_id LIMIT 40""",
    "finding_details": f"""WITH {_FINDINGS}, o AS (SELECT l_orderkey * 10 + l_linenumber AS occurrence_id, CAST(l_partkey AS VARCHAR) AS k, CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_quantity AS BIGINT) END AS affected, CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS BIGINT) + l_orderkey % 5 ELSE 0 END AS total,
 CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS INTEGER) AS place FROM lineitem QUALIFY place <= 3) SELECT id, status, occurrence_id, affected, total, place FROM f LEFT JOIN o ON o.k = f.id""",
    "dashboard_kpis": """SELECT (SELECT count(*) FROM customer) AS accounts, (SELECT max(c_custkey % 1000) FROM customer) AS last_crawled_at, (SELECT count(*) FROM events) AS posts,
 (SELECT count(*) FROM (SELECT o_custkey FROM (SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1) GROUP BY 1 HAVING bool_or(o_orderstatus = 'F'))) AS labeled_accounts""",
    "top_labels": f"WITH {_S} SELECT label_key, true_count FROM s WHERE completeness = 'complete' QUALIFY row_number() OVER (PARTITION BY label_key ORDER BY at_ms DESC, id DESC) = 1 ORDER BY true_count DESC, label_key LIMIT 3",
    "redacted_errors": "WITH x AS (SELECT page_id, url, string_split(html, chr(10))[1] AS l FROM pages) SELECT page_id, CASE WHEN length(l) > 60 THEN left(l, 60) || '…' ELSE l END AS shown, lower(url || ' Page') AS document FROM x",
    "sampled_follow_signals": """WITH f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT DISTINCT CAST(l_suppkey % 50 AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem WHERE l_orderkey % 4 = 0),
 l AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS label_key, o_orderstatus = 'F' AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1),
 x AS (SELECT e.a AS account_id, label_key, count(*) AS t, count(*) FILTER (value) AS v FROM (SELECT a, b FROM f UNION SELECT a, b FROM s) e JOIN l ON l.id = e.b GROUP BY ALL), y AS (SELECT f.b AS account_id, label_key, count(*) AS t, count(*) FILTER (value) AS v FROM f JOIN l ON l.id = f.a GROUP BY ALL)
 SELECT account_id, label_key, coalesce(x.t, 0) AS followee_total, coalesce(x.v, 0) AS followee_labeled, coalesce(y.t, 0) AS follower_total, coalesce(y.v, 0) AS follower_labeled FROM x FULL JOIN y USING (account_id, label_key)""",
    "rule_candidates": """WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS account_id, o_orderpriority AS label_key, o_orderstatus = 'F' AS value, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 1001 AS confidence_milli, '1.' || (o_orderkey % 3) || '.0' AS v FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1),
 b AS (SELECT account_id, label_key, confidence_milli FROM l WHERE value AND account_id <> '7' AND ((label_key = '1-URGENT' AND v = '1.1.0' AND confidence_milli >= 200) OR (label_key = '2-HIGH' AND v = '1.2.0' AND confidence_milli >= 600)) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY confidence_milli DESC, label_key) = 1),
 k AS (SELECT l_partkey AS n, max(l_returnflag) AS flag, max(l_linestatus) AS status, count(*) AS skips FROM lineitem WHERE l_suppkey = 7 GROUP BY 1)
 SELECT * FROM b WHERE account_id NOT IN (SELECT CAST(n AS VARCHAR) FROM k WHERE (status = 'F' AND n % 3 = 0) OR flag = 'R' OR n % 5 IN (0, 4) OR (n % 5 IN (1, 3) AND (skips >= 2 OR n % 100 + 30 > 100)))
 AND account_id NOT IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 UNION SELECT CAST(o_custkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 7) ORDER BY confidence_milli DESC, account_id LIMIT 60""",
}
ORACLE_SQL |= {name: shown_sql(ORACLE_SQL[name], *NULLS[name]) for name in NULLS}
