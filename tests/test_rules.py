"""Label rules at their edges: links, texts, own threads, windows, bios."""

import pytest
from pyspark.sql import functions as F

from murmuration.operators import rules
from murmuration.plans.rule_sql import JUDGED_BIOS
from murmuration.sources.signals import TOPIC_BIOS

LINKS = {
    "https://www.amazon.co.jp/dp/B01?tag=shop-22": "associate-tag", "http://amazon.com/?a=1&tag=x#frag": "associate-tag", "HTTPS://AMZN.TO/abc": "associates-short-link", "https://user@amzn.to/x": "associates-short-link", "https://m.amazon.de:8443/x?tag=%41": "associate-tag",
    "https://amazon.co.jp/x#y?tag=a": None, "https://amazon.com/?tag=%20": None, "https://amazon.com/?tag=": None, "https://amazon.com/?tag": None, "https://amazon.com/?tag=+": None, "https://amazon.com/?tag=&tag=b": None, "https://amazon.com/?nottag=a": None, "https://amazon.com/?TAG=a": None,
    "https://amazon.com.evil.example/?tag=a": None, "https://notamazon.com/?tag=a": None, "ftp://amazon.com/?tag=a": None, "https://amzn.to.example/": None, "amzn.to/x": None, "": None, "https://amazon.com/?tag=%zz": "associate-tag", "https://amazon.com/tag=a?x=1": None,
}


def evaluated(spark, expression, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    return [r[0] for r in rows.select(expression(F.col("v"))).collect()]


def test_amazon_links(spark):
    assert dict(zip(LINKS, evaluated(spark, rules.amazon_kind, LINKS))) == LINKS


def test_listed_hosts(spark):
    urls = {"https://1link.jp/x": "95%", "http://a.B-Short.link": "near 100%", "https://me:pw@video.twimg.one:80/": "near 100%", "https://x1link.jp/": None, "https://1link.jp.example": None, "https://example/?u=https://1link.jp": None}
    assert dict(zip(urls, evaluated(spark, lambda v: rules.scam_risk(v, rules.SCAM_HOSTS), urls))) == urls


def test_linguistic_content(spark):
    texts = {"https://t.co/a\nhttps://t.co/b": False, "RT @me: @you　https://t.co/a": False, "@a @b": False, " \n　﻿": False, "see https://t.co/a": True, "rt @x: hi": True, "#tag": True, "": False, "。": True}
    assert dict(zip(texts, evaluated(spark, rules.linguistic, texts))) == texts


def test_word_bounds_stand_beside_other_letters(spark):
    assert evaluated(spark, lambda v: rules.has(v, r"\b(anime|manga)\b"), ["アニメanimeが", "animes", "xanime", "Manga!", "man ga"]) == [True, False, False, True, False]


ACCOUNT = "id string, screen_name string, tweet_count long, age_days double, fetched boolean"
POST = "id string, account_id string, at_us long, text string, is_reply boolean, is_retweet boolean, is_promoted boolean, is_paid boolean, in_reply_to string, urls array<string>"
HOUR = 3_600_000_000


def post(i, text, account="a", reply=False, rt=False, to=None, urls=(), at=None, promoted=False):
    return (f"p{i}", account, at if at is not None else i * HOUR, text, reply, rt, promoted, False, to, list(urls))


def told(spark, posts, key, accounts=(("a", "me", 10, 100.0, True),)):
    rows = rules.rules(spark.createDataFrame(list(accounts), ACCOUNT), spark.createDataFrame(posts, POST)).where(F.col("label_key") == key).collect()
    return {r["account_id"]: r for r in rows}


LONG = "the very same text for everyone here"


@pytest.fixture(scope="module")
def several(spark):
    """Accounts with one kind of posts each, looked at by all rules at once."""
    posts = []

    def add(account, *own):
        posts.extend((f"{account}{p[0]}", account, *p[2:]) for p in own)

    add("thread", *[post(i, LONG if i % 2 else f"start number {i}", reply=i % 2 == 1, to=f"threadp{i - 1}" if i % 2 else None) for i in range(12)])
    add("spread", *[post(i, f"@x{i} {LONG} https://t.co/{i}", reply=True, to=f"t{i}") for i in range(6)])
    add("reposts", *[post(i, LONG, reply=True, rt=True, to=f"t{i}") for i in range(6)])
    add("slow", *[post(i, LONG, reply=True, to=f"t{i}", at=i * 7 * HOUR) for i in range(6)])
    add("few", *[post(i, LONG, reply=True, to=f"t{i % 4}") for i in range(9)])
    add("bare", *[post(i, "https://t.co/a\nhttps://t.co/b") for i in range(3)], post(3, "https://t.co/a"), post(4, "words"))
    add("links", post(0, "a", urls=["https://amzn.to/old"]), post(1, "b", urls=["https://ok.example", "https://amazon.com/?tag=new", "https://amzn.to/x"], promoted=True), post(2, "RT", rt=True, urls=["https://amzn.to/x"]))
    add("japan", *[post(i, "今日は良い天気") for i in range(4)], *[post(i, "RT @japan_me:  @x nice to see you", rt=True) for i in range(4, 8)], post(8, "RT @other: @x nice", rt=True))
    add("old", *[post(i, "https://t.co/a", at=i) for i in range(10)], *[post(i, "plain words", at=i) for i in range(10, 30)])
    add("duplicates", post(0, LONG), post(1, LONG, reply=True, to="t"), post(2, LONG + " two"), post(3, LONG + " TWO @you", reply=True, to="t"), post(4, "🎉" * 10), post(5, "🎉" * 10, reply=True, to="t"))
    accounts = [(a, f"{a}_me", 10, 100.0, a != "few") for a in ("thread", "spread", "reposts", "slow", "few", "bare", "links", "japan", "old", "duplicates", "silent")]
    found = rules.rules(spark.createDataFrame(accounts, ACCOUNT), spark.createDataFrame(posts, POST)).collect()
    return {(r["account_id"], r["label_key"]): r for r in found}


def test_one_row_for_each_account_and_rule(several):
    assert len(several) == 11 * 16 and all(r["reason"] and r["rule_version"] for r in several.values())
    assert not several["silent", "bot"]["evaluable"] and several["silent", "amazon_affiliate_link"]["confidence"] == 1.0


def test_templates_leave_own_threads_and_reposts_out(several):
    key = "cross_target_templated_reply"
    assert several["spread", key]["value"] and several["spread", key]["reason"].startswith("targetCount=6, replies=6, spanHours=5.0, textHash=")
    assert not any(several[a, key]["value"] for a in ("thread", "reposts", "slow", "few", "silent"))
    assert several["few", key]["confidence"] == 0.5 and several["slow", key]["confidence"] == 1.0


def test_bare_links_on_several_lines_count(several):
    assert several["bare", "bare_link_spam"]["reason"] == "bareLinkRatio=0.80 (n=4/5)" and several["bare", "bare_link_spam"]["value"]


def test_only_recent_posts_count(several):
    assert several["old", "bare_link_spam"]["reason"] == "bareLinkRatio=0.00 (n=0/20)"


def test_first_link_of_the_newest_post_with_one(several):
    assert several["links", "amazon_affiliate_link"]["reason"] == "tweet=linksp1, evidence=associate-tag, host=amazon.com" and several["links", "amazon_affiliate_link"]["confidence"] == 1.0
    assert several["links", "amazon_affiliate_promoted"]["reason"] == "tweet=linksp1, evidence=associate-tag, host=amazon.com, paidPromotion=false, prDisclosure=false"


def test_reposts_of_own_replies_are_replies(several):
    r = several["japan", "reply_language_mismatch"]
    assert (r["value"], r["reason"]) == (True, "ownJapaneseRatio=1.00 (n=4), replyJapaneseRatio=0.00 (n=4)")


def test_texts_are_measured_in_utf16_units(several):
    assert several["duplicates", "self_duplicate_reply"]["reason"] == "selfDuplicatePostReplyPairs=3"  # ten party poppers are twenty units
    assert several["thread", "self_duplicate_reply"]["reason"] == "selfDuplicatePostReplyPairs=0"


def test_ai_media_is_zero_without_any(spark):
    schema = POST + ", ai_media boolean, ai_source string"
    posts = [(*post(i, "x"), ai, source) for i, (ai, source) in enumerate([(None, None), (False, None), (True, None), (True, "UserDeclared"), (True, "Other")])]
    accounts = spark.createDataFrame([("a", "me", 1, 1.0, True), ("b", "me", 1, 1.0, True)], ACCOUNT)
    got = {r["account_id"]: r for r in rules.rules(accounts, spark.createDataFrame(posts, schema)).where("label_key = 'tweet_ai_generated_media'").collect()}
    assert (got["a"]["confidence"], got["a"]["reason"]) == (0.9, "aiGeneratedMediaTweetCount=3 (n=5), sources=Other,UserDeclared,unknown") and (got["b"]["confidence"], got["b"]["reason"]) == (0.0, "aiGeneratedMediaTweetCount=0 (n=0), sources=none")


def test_topics_of_bios_judged_by_hand(spark):
    assert [b for b, _ in JUDGED_BIOS] == list(TOPIC_BIOS)
    more = (
        ("元自民党員、今は市議会議員です。", "politics"), ("自民党員になりたい", ""), ("crypto 🚫", ""), ("NFTs are fun, not a scam", "crypto"), ("R18禁止", ""), ("NSFW/R18", "nsfw"), ("音楽/映画/旅", "music"), ("生成AIで作った画像は全部ここ", "ai"), ("生成AI(勉強中)", ""), ("AIで生成した作品を投稿しています 研究者", "ai"), ("not AI-generated", ""), ("生成AI使ってる方はブロック", ""),
    )
    bios = [(str(i), b) for i, (b, _) in enumerate((*JUDGED_BIOS, *more))]
    signals = spark.createDataFrame([], "account_id string, label_key string, followee_total long, followee_labeled long")
    got = {}
    for r in rules.topic_rules(spark.createDataFrame(bios, "id string, bio string"), signals, spark.createDataFrame([], POST)).where("value").collect():
        got.setdefault(int(r["account_id"]), set()).add(r["label_key"].removeprefix("topic_").replace("ai-generated", "ai"))
    assert got == {i: set(about.split()) for i, (_, about) in enumerate((*JUDGED_BIOS, *more)) if about}
