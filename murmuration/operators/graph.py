"""Follow graph counts, block candidates and block reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import latest


def follow_signals(follow: DataFrame, history: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """By account and label: followees and followers with the label's verdict, and those of them with the label.

    `samples` (account_id, followee_id) are followees seen besides; an edge in both counts once. An edge is sent once for both directions, and each with its other account's labels as numbers, which are
    taken apart where an account's edges have met; what one task has counted is added up after that, so an account that very many follow is split by size at run time.
    """
    newest = latest(history)
    names = newest.select("label_key").distinct().withColumn("number", F.row_number().over(Window.orderBy("label_key")))  # as many as there are labels
    numbered = newest.join(F.broadcast(names), newest["label_key"].eqNullSafe(names["label_key"])).select(F.col("account_id").alias("other"), (F.col("number") * 2 + F.coalesce("value", F.lit(False)).cast("int")).alias("label"))
    known = numbered.groupBy("other").agg(F.collect_list("label").alias("labels"))
    edge = lambda account, other, out: F.struct(F.col(account).alias("account_id"), F.col(other).alias("other"), F.lit(out).alias("out"))
    there, back, seen = edge("follower_id", "followee_id", True), edge("followee_id", "follower_id", False), None
    if samples is not None:
        seen = samples.select(F.col("account_id").alias("follower_id"), "followee_id")
        follow = follow.join(seen.distinct().withColumn("seen", F.lit(True)), ["follower_id", "followee_id"], "left")
        there = F.when(F.col("seen").isNull(), there)
    edges = follow.select(F.explode(F.array_compact(F.array(there, back))).alias("e")).select("e.*")
    if seen is not None:
        edges = edges.unionByName(seen.select(edge("follower_id", "followee_id", True).alias("e")).select("e.*"))
    # Dealt by a cell of the account, which is not the key of the counts: Spark may split a cell by its size, and adds up what its parts have counted.
    met = edges.join(known, "other").select(F.pmod(F.hash("account_id"), F.lit(1 << 16)).alias("cell"), "account_id", "out", "labels").hint("rebalance", "cell")
    each = met.select("account_id", "out", F.explode("labels").alias("label")).select("account_id", "out", F.shiftright("label", 1).alias("number"), (F.col("label") % 2 == 1).alias("value"))
    counts = {f"{name}_{what}": F.count_if(cond) for name, side in (("followee", F.col("out")), ("follower", ~F.col("out"))) for what, cond in (("total", side), ("labeled", side & F.col("value")))}
    by = each.groupBy("account_id", "number").agg(*[c.alias(n) for n, c in counts.items()])
    return by.join(F.broadcast(names), "number").select("account_id", "label_key", *counts)


def rule_candidates(newest: DataFrame, targets: DataFrame, blocker: str, follow: DataFrame, blocks: DataFrame, actions: DataFrame, outbox: DataFrame, now_s: int, most_skips: int, cooldown_s: int, limit: int) -> DataFrame:
    """account_id, label_key, confidence_milli: whom a rule would block next, by confidence.

    Of `newest` (latest labels) those that are true, of a target's current version and at its threshold (`targets`: label_key, rule_version, least_milli; one row each), the surest of each account. Left out are the blocker, accounts that it
    blocks (blocker_id, blocked_id), has blocked with success (`actions`: result), follows or is followed by, and those in its `outbox` (status, skips, skipped_s) that are on their way, were skipped too often or not long ago.
    """
    rows = newest.where(F.col("value") & (F.col("account_id") != blocker)).join(F.broadcast(targets), ["label_key", "rule_version"]).where(F.col("confidence_milli") >= F.col("least_milli"))
    best = rows.groupBy("account_id").agg(F.min_by(F.struct("label_key", "confidence_milli"), F.struct(-F.col("confidence_milli"), "label_key")).alias("b")).select("account_id", "b.*")
    own = lambda df: df.where(F.col("blocker_id") == blocker)
    waiting = F.col("status").isin("pending_remote", "remote_succeeded") | ((F.col("status") == "remote_skipped") & ((F.col("skips") >= most_skips) | (F.col("skipped_s") + cooldown_s > now_s)))
    tied = follow.where(F.col("follower_id") == blocker).select(F.col("followee_id").alias("account_id")).union(follow.where(F.col("followee_id") == blocker).select("follower_id"))
    done = own(blocks).select("blocked_id").union(own(actions).where("result = 'success'").select("blocked_id")).union(own(outbox).where(waiting).select("blocked_id")).toDF("account_id")
    # All reasons to leave an account out are one set of ids, and one anti join.
    return best.join(tied.union(done), "account_id", "left_anti").orderBy(F.desc("confidence_milli"), "account_id").limit(limit)


def block_candidates(history: DataFrame, follow: DataFrame, blocks: DataFrame, blocker: str, version: str, least_milli: int, limit: int) -> DataFrame:
    """Accounts with a true label of the current version and enough confidence, best label each, that the blocker
    neither follows, is followed by, nor blocks; by confidence."""
    best = Window.partitionBy("account_id").orderBy(F.col("confidence_milli").desc(), "label_key")
    rows = latest(history).where(F.col("value") & (F.col("rule_version") == version) & (F.col("confidence_milli") >= least_milli))
    rows = rows.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    # either direction of an edge is one equi anti join
    tied = follow.where(F.col("follower_id") == blocker).select(F.col("followee_id").alias("account_id")).union(follow.where(F.col("followee_id") == blocker).select("follower_id"))
    blocked = blocks.where(F.col("blocker_id") == blocker).select(F.col("blocked_id").alias("account_id"))
    rows = rows.join(tied, "account_id", "left_anti").join(blocked, "account_id", "left_anti")
    return rows.orderBy(F.col("confidence_milli").desc(), "account_id").limit(limit).select("account_id", "label_key", "confidence_milli")


def reconcile_blocks(blocks: DataFrame, seen: F.Column, complete: F.Column, resolve_after: int = 3) -> DataFrame:
    """Present relations are active; absent ones count up and are missing, then resolved; an incomplete observation keeps the stored status and count."""
    count = F.when(seen, 0).when(~complete, F.col("missing_before")).otherwise(F.col("missing_before") + 1)
    status = F.when(seen, "active").when(~complete, F.col("status_before")).when(F.col("missing_before") + 1 >= resolve_after, "resolved").otherwise("missing")
    return blocks.select("blocker_id", "blocked_id", status.alias("status"), count.cast("long").alias("missing_count"))


def edge_sync(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges (src, dst) of a stored set and of what was seen, each once: added, kept or removed."""
    both = stored.distinct().withColumn("old", F.lit(True)).join(seen.distinct().withColumn("new", F.lit(True)), ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("kept").alias("state"))
