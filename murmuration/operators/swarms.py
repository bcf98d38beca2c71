"""Replies that flood one target: by one account, and by a swarm of accounts with a reply each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import confidence, ramp
from ..functions.text import fixed, long_enough, normalize_for_similarity
from ..sources.kept import kept
from .review import without_common_words
from .similarity import average_likeness, greatest_likeness, like_sums, likeness, similarity_of, weighed

# Fixed values of the rules.
WINDOW_MS = 24 * 3600 * 1000
LEAST_AUTHORS, LEAST_LIKENESS = 5, 0.1
LEAST_SAMPLE, LEAST_REPLY_RATIO = 3, 0.5
LEAST_REPLIES, LEAST_FLOOD_LIKENESS = 8, 0.03
#: From so many distinct texts on a bound may settle that a target is no swarm; what a bound has to stay under the least likeness by.
BOUND_TEXTS, MARGIN = 2048, 1e-6
VERSIONS = {"reply_hijack_swarm": "1.5.0", "reply_flooding": "1.4.0"}


def _ms() -> Column:
    return F.floor(F.col("at_us") / 1000)


def first_replies(replies: DataFrame) -> DataFrame:
    """target, account_id, ms, text (normalised): the earliest reply of each account to each target; of several at one time that with the greatest id. Short replies and those to nobody don't count."""
    text = F.filter(F.array(normalize_for_similarity(F.col("text"))), long_enough)  # exploded, so that it is normalised once
    rows = replies.where(F.col("target").isNotNull()).select("target", "account_id", "id", _ms().alias("ms"), F.explode(text).alias("text"))
    best = rows.groupBy("target", "account_id").agg(F.max_by(F.struct("ms", "text"), F.struct(-F.col("ms"), "id")).alias("r"))
    return best.select("target", "account_id", "r.*")


def swarm_index(first: DataFrame, measured: bool = True) -> DataFrame:
    """target, authors, least, most, second_least, second_most (ms), both (likeness summed over ordered pairs), similarity, swarm (whether it is one) and open (whether it is one or one entry may make it one), of all targets with replies.

    Counts and times are added up before they are sent, and pairs are compared in tiles, so a target with very many replies is no single task's.
    Pairs are compared where the span and the number of authors allow a swarm, or would with one author or one time less; if the likeness itself isn't wanted (not `measured`),
    not where a bound tells that it is too small, even with one entry more. Likeness is null where pairs aren't compared.
    """
    ms, ends = F.col("ms"), first.groupBy("target").agg(F.count("*").alias("authors"), F.min("ms").alias("least"), F.max("ms").alias("most"))
    inner = first.join(ends, "target").groupBy("target").agg(
        F.when(F.count_if(ms == F.col("least")) > 1, F.min("least")).otherwise(F.min(F.when(ms > F.col("least"), ms))).alias("second_least"),
        F.when(F.count_if(ms == F.col("most")) > 1, F.max("most")).otherwise(F.max(F.when(ms < F.col("most"), ms))).alias("second_most"),
    )
    by = ends.join(inner, "target")
    without_one = F.least(F.col("most") - F.col("second_least"), F.col("second_most") - F.col("least"))
    near = by.where((F.col("authors") >= LEAST_AUTHORS - 1) & (without_one <= WINDOW_MS)).select("target")
    texts = first.join(near, "target", "left_semi").select(F.col("target").alias("grp"), "text")
    if not measured:
        texts = texts.join(kept(unlike_targets(texts)), "grp", "left_anti")
    like = average_likeness(texts).select(F.col("grp").alias("target"), (F.col("similarity") * F.col("n") * (F.col("n") - 1)).alias("both"), "similarity")
    rows = by.join(like, "target", "left")
    return rows.withColumns({"swarm": _is_swarm(F.col("authors"), F.col("most") - F.col("least"), F.coalesce("similarity", F.lit(0.0))), "open": F.col("both").isNotNull()})


def unlike_targets(texts: DataFrame) -> DataFrame:
    """grp: those of the large groups of normalised texts (grp, text) whose likeness is too small for a swarm with any entry added or changed.

    One entry changes the mean of n by 2 / n at most.
    """
    distinct = kept(weighed(texts))
    large = distinct.groupBy("grp").agg(F.count("*").alias("texts")).where(F.col("texts") >= BOUND_TEXTS).select("grp")
    bounds = greatest_likeness(distinct.join(large, "grp", "left_semi"))
    return bounds.where(F.col("most") + 2 / F.col("n") < LEAST_LIKENESS - MARGIN).select("grp")


def _is_swarm(authors: Column, span_ms: Column, similarity: Column) -> Column:
    return (authors >= LEAST_AUTHORS) & (span_ms <= WINDOW_MS) & (F.round(similarity, 12) >= LEAST_LIKENESS)


def swarm_sizes(first: DataFrame, index: DataFrame) -> DataFrame:
    """account_id and size: the largest swarm that each account has a reply in."""
    return first.join(index.where("swarm").select("target", "authors"), "target").groupBy("account_id").agg(F.max("authors").alias("size"))


def augmented(first: DataFrame, index: DataFrame, own: DataFrame) -> DataFrame:
    """account_id, target, authors, similarity, swarm: the index as it would be with one account's own replies (as in `replies`) added, for each of `own` alone.

    The index isn't built again: an account's entry, if it has an earlier one now, is taken out of the target's sums and its new one put in, by its likeness to the target's members.
    That is done for targets that the index has open; with others it is no swarm in any case, and its similarity is null.
    """
    new = first_replies(own).select("target", "account_id", F.col("ms").alias("new_ms"), F.col("text").alias("new_text"))
    now = first.select("target", "account_id", F.col("ms").alias("old_ms"), F.col("text").alias("old_text"))
    rows = new.join(now, ["target", "account_id"], "left").join(index.drop("similarity", "swarm"), "target", "left")
    # The corpus comes first: a reply at the same time doesn't take an entry's place.
    stays = F.coalesce(F.col("old_ms") <= F.col("new_ms"), F.lit(False))
    rows = rows.select(
        "target", "account_id", F.when(stays, F.col("old_ms")).otherwise(F.col("new_ms")).alias("ms"), F.when(stays, F.col("old_text")).otherwise(F.col("new_text")).alias("text"),
        "old_ms", "old_text", F.coalesce("authors", F.lit(0)).alias("members"), "least", "most", "second_least", "second_most", F.coalesce("both", F.lit(0.0)).alias("both"), F.coalesce("open", F.lit(False)).alias("open"),
    )
    rows = kept(rows)  # read for what is wanted, and again to add it up
    members = weighed(first.select(F.col("target").alias("grp"), "text"))
    asked = rows.where("open")
    wanted = asked.select(F.col("target").alias("grp"), "text").unionByName(asked.where("old_text IS NOT NULL").select(F.col("target").alias("grp"), F.col("old_text").alias("text"))).distinct()
    wanted = kept(wanted)
    sums = kept(like_sums(wanted, members.join(wanted.select("grp").distinct(), "grp", "left_semi"))).withColumnRenamed("grp", "target")
    rows = rows.join(sums.select("target", F.col("text"), F.col("total").alias("to_all")), ["target", "text"], "left")
    rows = rows.join(sums.select("target", F.col("text").alias("old_text"), F.col("total").alias("old_to_all")), ["target", "old_text"], "left")
    had = F.col("old_text").isNotNull()
    others_old = F.when(had, F.col("old_to_all") - 1.0).otherwise(0.0)  # entries aren't empty: each is 1 to itself
    others_new = F.coalesce("to_all", F.lit(0.0)) - F.when(had, likeness(F.col("text"), F.col("old_text"))).otherwise(0.0)
    rows = rows.withColumns({"authors": F.when(had, F.col("members")).otherwise(F.col("members") + 1), "sum": F.col("both") + 2 * (others_new - others_old)})
    least = F.least("ms", F.when(had & (F.col("old_ms") == F.col("least")), F.col("second_least")).otherwise(F.col("least")))
    most = F.greatest("ms", F.when(had & (F.col("old_ms") == F.col("most")), F.col("second_most")).otherwise(F.col("most")))
    rows = rows.withColumns({"similarity": F.when(F.col("open"), similarity_of("sum", "authors")), "span": most - least})
    return rows.select("account_id", "target", "authors", "similarity", _is_swarm(F.col("authors"), F.col("span"), F.coalesce("similarity", F.lit(0.0))).alias("swarm"))


def swarm_rule(accounts: DataFrame, posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rule reply_hijack_swarm for every account (id, fetched) by its recent posts (account_id, is_reply) and swarm sizes."""
    by = posts.groupBy("account_id").agg(F.count("*").alias("n"), F.count_if("is_reply").alias("replies"))
    rows = accounts.select(F.col("id").alias("account_id"), "fetched").join(by, "account_id", "left").join(sizes, "account_id", "left").fillna(0, ["n", "replies", "size"])
    ratio = F.when(F.col("n") > 0, F.col("replies") / F.col("n")).otherwise(0.0)
    enough = (F.col("n") >= LEAST_SAMPLE) & F.col("fetched")
    value = (F.col("size") >= LEAST_AUTHORS) & enough & (ratio >= LEAST_REPLY_RATIO)
    evidence = F.least(ramp(F.col("size"), LEAST_AUTHORS, LEAST_AUTHORS), F.when(enough, ramp(ratio, LEAST_REPLY_RATIO, 0.5)).otherwise(0.0))
    reason = F.concat(F.lit("replyHijackSwarmSize="), F.col("size").cast("string"), F.lit(", replyRatio="), fixed(ratio, 2), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))
    return _labelled(rows, "reply_hijack_swarm", value, evidence, enough, reason)


def _labelled(rows: DataFrame, key: str, value: Column, evidence: Column, evaluable: Column, reason: Column) -> DataFrame:
    sure = F.round(confidence(value, evidence, evaluable), 6)
    return rows.select("account_id", F.lit(key).alias("label_key"), F.lit(VERSIONS[key]).alias("rule_version"), value.alias("value"), sure.alias("confidence"), evaluable.alias("evaluable"), reason.alias("reason"))


def floods(posts: DataFrame) -> DataFrame:
    """account_id, target, replies, similarity, mention: of each account the flooded target with the most alike replies, if any; of equals the one with the newest reply.

    `posts`: the recent ones; id, account_id, at_us, is_reply, is_retweet, in_reply_to, text. A flooded target has LEAST_REPLIES replies or more of the account, all within a day.
    """
    rows = posts.where(F.col("is_reply") & ~F.col("is_retweet") & F.col("in_reply_to").isNotNull()).select("account_id", F.col("in_reply_to").alias("target"), "id", "text", _ms().alias("ms"))
    newest = F.struct("ms", "id")
    by = rows.groupBy("account_id", "target").agg(F.count("*").alias("replies"), (F.max("ms") - F.min("ms")).alias("span"), F.max(newest).alias("newest"), F.max_by("text", newest).alias("shown"))
    by = by.where((F.col("replies") >= LEAST_REPLIES) & (F.col("span") <= WINDOW_MS)).withColumn("grp", F.struct("account_id", "target"))
    texts = rows.withColumn("grp", F.struct("account_id", "target")).join(by.select("grp"), "grp", "left_semi").select("grp", "id", normalize_for_similarity(F.col("text"), remove_hashtags=True).alias("text"))
    like = average_likeness(without_common_words(texts).select("grp", "text")).where(F.round("similarity", 12) >= LEAST_FLOOD_LIKENESS)
    best = like.join(by, "grp").groupBy("account_id").agg(F.max_by(F.struct("target", "replies", "similarity", "shown"), F.struct(F.round("similarity", 12), "newest")).alias("b"))
    mention = F.regexp_extract("b.shown", r"^@(\w+)", 1)
    return best.select("account_id", "b.target", "b.replies", "b.similarity", F.when(mention == "", "unknown").otherwise(mention).alias("mention"))


def flooding_rule(accounts: DataFrame, posts: DataFrame) -> DataFrame:
    """The rule reply_flooding for every account (id, fetched)."""
    rows = accounts.select(F.col("id").alias("account_id"), "fetched").join(floods(posts), "account_id", "left")
    value = F.col("target").isNotNull()
    evidence = F.when(value, 0.4 * ramp(F.col("replies"), LEAST_REPLIES, 12) + 0.6 * ramp(F.col("similarity"), LEAST_FLOOD_LIKENESS, 0.12)).otherwise(0.0)
    found = F.concat(F.lit("target=@"), F.col("mention"), F.lit(", replies="), F.col("replies").cast("string"), F.lit(", avgSimilarity="), fixed(F.round("similarity", 12), 3))
    return _labelled(rows, "reply_flooding", value, evidence, value | F.col("fetched"), F.coalesce(F.when(value, found), F.lit("no reply-flooding target found")))
