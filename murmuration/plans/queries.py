"""Name -> query over whole driver tables, and name -> the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import behaviour, findings, graph, history, rules, upserts
from ..sources import adapters, signals
from . import payload_queries, planning_queries, review_queries, signal_queries, summary_queries, view_queries

AS_OF = "2001-08-02 00:00:00"
DAY = "yyyy-MM-dd HH:mm:ss"


def _stamp(col: str):
    return F.date_format(col, DAY).alias(col)


def latest_labels(spark, d):
    rows = history.latest(adapters.label_history(spark, d))
    return rows.select("account_id", "label_key", "id", "value", "confidence_milli", "rule_version", _stamp("labeled_at"))


def previous_labels(spark, d):
    return history.nth_latest(adapters.label_history(spark, d), 2).select("account_id", "label_key", "id", "value")


def compacted_history(spark, d):
    return history.compacted(adapters.label_history(spark, d)).select("account_id", "label_key", "id", "value", "rule_version")


def label_changes(spark, d):
    return history.changes(adapters.label_history(spark, d)).select("account_id", "label_key", "id", "change_type")


def label_snapshot(spark, d):
    h = adapters.label_history(spark, d)
    rows = history.snapshot(h, adapters.account(spark, d))
    rounded = ("prevalence", "coverage", "avg_confidence_true", "avg_confidence_false")
    return rows.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in rows.columns])


def label_distributions(spark, d):
    return history.distributions(adapters.label_history(spark, d))


def confidence_diagnostics(spark, d):
    return history.diagnostics(adapters.label_history(spark, d))


def label_freshness(spark, d):
    return history.freshness(adapters.label_history(spark, d), AS_OF, 365, 1000)


def account_summary(spark, d):
    rows = history.account_summary(adapters.label_history(spark, d))
    return rows.select("account_id", "active_label_keys", "active_label_count", "evaluated_label_count", _stamp("last_labeled_at"))


def stale_accounts(spark, d):
    current = spark.createDataFrame([("1-URGENT", "1.1.0"), ("2-HIGH", "1.2.0"), ("3-MEDIUM", "1.1.0")], "label_key string, rule_version string")
    return history.stale_accounts(adapters.account(spark, d), adapters.label_history(spark, d), current)


def review_sample(spark, d):
    return history.seeded_sample(adapters.label_history(spark, d), "seed-7", 5)


def count_drops(spark, d):
    rows = history.count_drops(history.monthly(adapters.label_history(spark, d)), 5, 0.2)
    return rows.withColumn("drop", F.round("drop", 6))


def follow_signals(spark, d):
    return graph.follow_signals(adapters.follow(spark, d), adapters.label_history(spark, d))


def block_candidates(spark, d):
    return graph.block_candidates(adapters.label_history(spark, d), adapters.follow(spark, d), adapters.block(spark, d), "7", "1.1.0", 300, 50)


def block_reconciliation(spark, d):
    return graph.reconcile_blocks(adapters.block(spark, d), F.col("flag") == "N", F.col("status") == "O")


def recent_tweets(spark, d):
    return behaviour.recent(adapters.tweet(spark, d), 20).select("account_id", "id", "n")


def behaviour_ratios(spark, d):
    rows = behaviour.ratios(adapters.tweet(spark, d))
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_ratio") else F.col(c) for c in rows.columns])


def posting_gaps(spark, d):
    return behaviour.gaps(adapters.tweet(spark, d)).withColumn("variation", F.round("variation", 6))


def sliding_targets(spark, d):
    return behaviour.sliding_targets(adapters.tweet(spark, d))


def duplicate_replies(spark, d):
    replies = adapters.post(spark, d).where("is_reply").select("account_id", text.normalize_reply(F.col("text")).alias("text"), F.col("in_reply_to").alias("target"))
    return behaviour.duplicate_replies(replies).select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "authors", "targets", "n", "unknown_target", "others")


def label_rules(spark, d):
    """The behavioural rules on posts, in long form."""
    return rules.rules(signals.persona_accounts(spark, d), signals.persona_posts(spark, d))


def topic_rules(spark, d):
    """Topics by bio, posts and followees; orders' priorities stand for five topics."""
    key = F.col("label_key")
    named = F.when(key == "1-URGENT", "topic_anime").when(key == "2-HIGH", "topic_food").when(key == "3-MEDIUM", "topic_music").when(key == "5-LOW", "topic_pets").otherwise("topic_travel")
    followed = graph.follow_signals(adapters.follow(spark, d), adapters.label_history(spark, d)).withColumn("label_key", named)
    return rules.topic_rules(signals.topic_accounts(spark, d), followed, signals.topic_posts(spark, d))


def as_of_drops(spark, d):
    """Each month's true rows against the newest complete month before it (20 evaluated rows make a month complete)."""
    months = history.monthly(adapters.label_history(spark, d)).withColumnRenamed("month", "observed").withColumn("complete", F.col("evaluated") >= 20)
    rows = history.completed_before(months)
    return rows.select("label_key", "observed", "true_count", F.col("baseline.observed").alias("baseline_observed"), F.col("baseline.true_count").cast("double").alias("baseline_true"))


def reason_shifts(spark, d):
    """Reasons of true rows in 1996 against 1995."""
    rows = adapters.label_history(spark, d).where("value")
    by = lambda year: rows.where(F.year("labeled_at") == year).groupBy("label_key", "reason").agg(F.count("*").alias("n"))
    return history.reason_shifts(by(1995), by(1996), 10, 0.2).withColumn("drop", F.round("drop", 6))


def daily_rollup(spark, d):
    """The last complete snapshot of each day and label, and its change against the day before that has one."""
    rows = adapters.label_history(spark, d).groupBy("label_key", "labeled_at").agg(F.count("*").alias("evaluated"), F.count_if("value").alias("true_count")).where("evaluated >= 2")
    return findings.daily(rows.withColumnRenamed("labeled_at", "observed")).withColumn("change", F.col("change").cast("double"))


def account_overview(spark, d):
    """Accounts with their summaries and severity floor: page of the most labelled ones, missing summaries as none."""
    summary = account_summary(spark, d)
    rows = adapters.account(spark, d).select(F.col("id").alias("account_id"), "screen_name").join(summary, "account_id", "left")
    rows = rows.select("account_id", "screen_name", F.coalesce("active_label_count", F.lit(0)).alias("active_label_count"), F.coalesce("active_label_keys", F.lit("")).alias("active_label_keys"), F.coalesce("last_labeled_at", F.lit("1970-01-01 00:00:00")).alias("last_labeled_at"))
    return rows.orderBy(F.col("active_label_count").desc(), "account_id").limit(50)


def shared_labels(spark, d):
    """Accounts that have any of two labels and the most of them, by overlap of their active labels."""
    rows = account_summary(spark, d).withColumn("keys", F.split("active_label_keys", ","))
    return rows.where(F.arrays_overlap("keys", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).select("account_id", "active_label_keys", F.size(F.array_intersect("keys", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).alias("hits"))


def edge_sync(spark, d):
    """Follow edges of 1995 against those of 1996: added, kept or removed."""
    o = adapters.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")).where("y IN (1995, 1996)")
    e = adapters.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), "y")
    return graph.edge_sync(e.where("y = 1995").drop("y"), e.where("y = 1996").drop("y"))


def retweet_rule(spark, d):
    return behaviour.retweet_rule(adapters.tweet(spark, d))


def reply_posterior(spark, d):
    return behaviour.reply_posterior(adapters.tweet(spark, d))


def profile_rules(spark, d):
    return behaviour.profile_rules(adapters.account(spark, d))


def bigram_similarity(spark, d):
    """Each benchmark item's text against the next item's."""
    rows = adapters.table(spark, d, "benchmark").select("item_id", text.normalize_for_similarity(F.col("text")).alias("t"))
    following = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    pairs = rows.join(following, "item_id").select("item_id", text.bigrams(F.col("t")).alias("a"), text.bigrams(F.col("u")).alias("b"))
    return pairs.select("item_id", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def url_hosts(spark, d):
    """Pages by host, and how many of them are under example.com or example.net."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    known = host.rlike(r"(^|\.)example\.(com|net)$")
    return adapters.table(spark, d, "pages").groupBy(host.alias("host"), known.alias("known")).agg(F.count("*").alias("pages"))


def account_page(spark, d):
    """Keyset page: accounts after a cursor in the order of followers, most first, then id."""
    rows = adapters.account(spark, d).select("id", "screen_name", "followers_count")
    after = (F.col("followers_count") < 5000) | ((F.col("followers_count") == 5000) & (F.col("id") > "0"))
    return rows.where(after).orderBy(F.col("followers_count").desc(), "id").limit(26)


def account_search(spark, d):
    """Search: exact id before prefix of the name before a part of it, five at most."""
    q = "12"
    rows = adapters.account(spark, d)
    rank = F.when(F.col("id") == q, 0).when(F.col("screen_name").startswith(q), 1).when(F.lower("screen_name").contains(q), 2)
    return rows.select("id", "screen_name", rank.alias("priority")).where("priority IS NOT NULL").orderBy("priority", "id").limit(5)


def calibration(spark, d):
    """By verdict of the classifier: weighted calibration, suppressed under 20 effective judgments."""
    rows = adapters.table(spark, d, "labels").join(adapters.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    w, right = F.col("n_chars"), F.when((F.col("quality") == 1) == (F.col("toxic") == 0), F.col("n_chars")).otherwise(0)
    by = rows.groupBy((F.col("quality") == 1).alias("classifier_value")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(right).alias("r"))
    effective = F.col("w").cast("double") * F.col("w") / F.col("w2")
    return by.select("classifier_value", "n", F.round(effective, 4).alias("n_eff"), F.when(effective >= 20, F.round(F.col("r") / F.col("w"), 6)).alias("correctness"))


def severity_ranks(spark, d):
    """Orders' priorities as severities, by rank."""
    o = adapters.table(spark, d, "orders")
    named = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("other")
    return o.select(named.alias("severity")).groupBy("severity").agg(F.count("*").alias("n")).withColumn("rank", scores.severity_rank("severity"))


def guarded_latest(spark, d):
    """Labels of 1996 and later into the latest ones of the years before."""
    h = adapters.label_history(spark, d)
    stored = history.latest(h.where(F.year("labeled_at") < 1996))
    return upserts.guarded(stored, h.where(F.year("labeled_at") >= 1996), history.KEY, ("labeled_at", "id")).select("account_id", "label_key", "id", "value")


def first_claims(spark, d):
    """Customers who ordered first in 1997: the first order of each one without an order before."""
    h = adapters.label_history(spark, d)
    rows = upserts.first_only(h.where(F.year("labeled_at") < 1997), h.where(F.year("labeled_at") == 1997).withColumn("place", F.struct("labeled_at", "id")), ("account_id",), "place")
    return rows.select("account_id", "id")


def retained_labels(spark, d):
    """Rows that a retention of 1996 on leaves, by label."""
    return upserts.retained(adapters.label_history(spark, d), "labeled_at", "1996-01-01").groupBy("label_key").agg(F.count("*").alias("n"))


def templated_targets(spark, d):
    """The rule on replies of one text to many targets within 24 hours, alone."""
    return rules.rules(signals.persona_accounts(spark, d), signals.persona_posts(spark, d), only=("cross_target_templated_reply",)).select("account_id", "value", "reason")


QUERIES = {f.__name__: f for f in (
    latest_labels, previous_labels, compacted_history, label_changes, label_snapshot, label_distributions, confidence_diagnostics, label_freshness, account_summary,
    stale_accounts, review_sample, count_drops, follow_signals, block_candidates, block_reconciliation, recent_tweets, behaviour_ratios, posting_gaps, sliding_targets,
    duplicate_replies, retweet_rule, reply_posterior, profile_rules, bigram_similarity, url_hosts, account_page, account_search, calibration, severity_ranks,
    label_rules, topic_rules, as_of_drops, reason_shifts, daily_rollup, account_overview, shared_labels, edge_sync,
    guarded_latest, first_claims, retained_labels, templated_targets,
)} | review_queries.QUERIES | signal_queries.QUERIES | summary_queries.QUERIES | planning_queries.QUERIES | payload_queries.QUERIES | view_queries.QUERIES
