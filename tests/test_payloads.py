"""Raw payloads of both shapes, malformed lines, and merges into stored rows."""

import json

from murmuration.operators import upserts
from murmuration.sources import payloads

USER = {"restId": "u1", "isBlueVerified": True, "legacy": {"description": "a bio", "followersCount": 10, "friendsCount": 5, "statusesCount": 100, "location": "Tokyo"}, "core": {"screenName": "test_user", "name": "Test User", "createdAt": "Wed Jan 01 00:00:00 +0000 2020"}}
POST = {"restId": "t1", "user": USER, "legacy": {"fullText": "hello", "createdAt": "Wed Jan 01 00:00:00 +0000 2020", "retweetCount": 3, "favoriteCount": 10, "replyCount": 1, "quoteCount": 0, "inReplyToStatusIdStr": None, "retweetedStatusIdStr": None}}


def lines(spark, *values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False),) for v in values], "value string")


def post(**legacy):
    return POST | {"legacy": POST["legacy"] | legacy}


def read(spark, *values, viewer="u1"):
    return payloads.posts(lines(spark, *values), "profile", viewer).collect()


def test_users_of_both_shapes(spark):
    old = {"restId": "u2", "legacy": {"screenName": "old", "createdAt": "2020-01-01T00:00:00Z"}, "verification": {"verifiedType": "Business"}}
    both = USER | {"restId": "u3", "legacy": USER["legacy"] | {"screenName": "stale", "name": "Stale"}}
    got = {r["id"]: r for r in payloads.accounts(lines(spark, USER, old, both, {"restId": "u4", "legacy": {}})).collect()}
    assert (got["u1"]["screen_name"], got["u1"]["created_ms"], got["u1"]["verified_type"], got["u1"]["image_url"]) == ("test_user", 1577836800000, None, None)
    assert (got["u2"]["screen_name"], got["u2"]["display_name"], got["u2"]["created_ms"], got["u2"]["verified_type"]) == ("old", "", 1577836800000, "Business")
    assert got["u3"]["screen_name"] == "test_user" and (got["u4"]["screen_name"], got["u4"]["created_ms"]) == ("", None)


def test_malformed_and_incomplete_lines(spark):
    bad = lines(spark, "{not json", None, "", '{"restId": "x"}', {"legacy": {}}, USER, '{"restId": "y", "legacy": {"followersCount": "many"}}')
    assert sorted((r["line"] or "", r["problem"]) for r in payloads.rejected(bad, payloads.USER).collect()) == sorted(
        [("{not json", "malformed"), ("", "malformed"), ("", "malformed"), ('{"restId": "x"}', "incomplete"), ('{"legacy": {}}', "incomplete"), ('{"restId": "y", "legacy": {"followersCount": "many"}}', "malformed")]
    )
    assert [r["id"] for r in payloads.accounts(bad).collect()] == ["u1"]
    assert payloads.accounts(bad.limit(0)).count() == payloads.posts(bad.limit(0), "profile", "u").count() == 0


def test_posts(spark):
    plain, reply, repost = read(spark, POST, post(inReplyToStatusIdStr="p"), post(retweetedStatusIdStr="r", isPromoted=True))
    assert (plain["is_reply"], plain["is_author_reply"], plain["is_promoted"], plain["expanded_urls"], plain["foreign_videos"], plain["ai_media"]) == (False, False, False, [], None, None)
    assert (reply["is_reply"], reply["in_reply_to"], reply["is_author_reply"]) == (True, "p", True) and (repost["is_retweet"], repost["is_promoted"]) == (True, True)
    assert not read(spark, post(inReplyToStatusIdStr="p"), viewer="else")[0]["is_author_reply"]
    urls = [{"url": " https://t.co/a ", "expandedUrl": None}, {"url": "x", "expandedUrl": "　https://b.example﻿"}, {"url": "https://t.co/a"}, {"url": "y", "expandedUrl": "  "}]
    assert read(spark, post(entities={"urls": urls}))[0]["expanded_urls"] == ["https://t.co/a", "https://b.example"]
    media = [{"type": "video", "sourceUserIdStr": "u9"}, {"type": "video", "sourceUserIdStr": "u1"}, {"type": "video"}, {"type": "animated_gif", "sourceUserIdStr": "u8"}, {"type": "photo", "sourceUserIdStr": "u9"}]
    assert [r["foreign_videos"] for r in read(spark, post(extendedEntities={"media": media}), post(extendedEntities={}), post(extendedEntities={"media": []}))] == [2, 0, 0]


def test_quoted_posts_that_cannot_be_seen(spark):
    quoted = lambda **more: post(quotedStatusResult={"result": {"restId": "q", **more}})
    rows = read(spark, quoted(), quoted(legacy={}, user={"restId": "a"}), quoted(legacy={"extendedEntities": {"media": [{"type": "photo"}]}}), quoted(legacy={"extendedEntities": {"media": [{"type": "video"}]}}), post(quotedStatusResult=None))
    assert [(r["quoted_id"], r["quoted_author_id"], r["quoted_has_video"]) for r in rows] == [("q", None, None), ("q", "a", False), ("q", None, False), ("q", None, True), (None, None, None)]


MERGED = "id string, likes long, flagged boolean, urls array<string>, quoted string, videos long, source string"
COLUMNS = (("likes",), ("flagged",), ("urls",), ("quoted",), ("videos",), ("source",))


def test_merges_take_new_counts_and_keep_what_was_found(spark):
    stored = [("a", 9, True, ["x"], "q", 2, "old"), ("b", 9, None, None, None, None, "old"), ("c", 1, False, ["x", "y"], None, None, "old"), ("d", 1, True, ["x"], None, None, "old")]
    batch = [("a", 4, False, ["y"], None, 1, "new", 1), ("a", 5, False, ["z", "x"], None, None, "newer", 2), ("b", 9, False, [], "n", None, "new", 1), ("b", 9, None, None, None, None, "new", 2), ("c", 1, None, ["y", "x"], None, None, "new", 3), ("e", 1, None, None, None, None, "new", 1)]
    got = {r["id"]: tuple(r)[1:] for r in upserts.monotone(spark.createDataFrame(stored, MERGED), spark.createDataFrame(batch, MERGED + ", seq long"), "id", "seq", *COLUMNS).collect()}
    assert got["a"] == (5, True, ["z", "x", "y"], "q", 2, "newer", True)  # a count may fall
    assert got["b"] == (9, False, [], "n", None, "new", True) and got["c"][-1] is False and got["d"] == (1, True, ["x"], None, None, "old", False) and got["e"][-1] is True


def test_profiles_keep_when_they_were_first_seen(spark):
    schema = "id string, bio string, first_seen long, image string"
    stored = spark.createDataFrame([("a", "x", 1, "i"), ("b", None, 2, "i"), ("c", "z", 3, "i")], schema)
    new = spark.createDataFrame([("a", "y", 9, "j", 2), ("a", "x", 8, "k", 3), ("b", None, 9, "j", 1), ("d", None, 9, "j", 1)], schema + ", seq long")
    got = {r["id"]: tuple(r)[1:] for r in upserts.replaced(stored, new, "id", "seq", ("first_seen",), ("bio",)).collect()}
    assert got == {"a": ("x", 1, "k", False), "b": (None, 2, "j", False), "c": ("z", 3, "i", False), "d": (None, 9, "j", True)}


def test_labels_that_change_nothing_are_no_history(spark):
    schema = "k string, value boolean, reason string, at long"
    latest = spark.createDataFrame([("a", True, "r", 5), ("b", True, None, 5), ("c", True, "r", 5)], schema)
    new = spark.createDataFrame([("a", True, "r", 9), ("b", True, "r", 9), ("c", False, "r", 4), ("d", True, None, 1)], schema)
    got = {r["k"]: (r["noop"], r["history"], r["newest"]) for r in upserts.recorded(latest, new, ("k",), ("value", "reason"), "at").collect()}
    assert got == {"a": (True, False, False), "b": (False, True, True), "c": (False, True, False), "d": (False, True, True)}
