"""Rules on bios, replies and swarms at their edges, against plain Python."""

import random
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from murmuration.functions import text
from murmuration.operators import similarity, solicitation, swarms
from murmuration.sources.kept import kept

ACCOUNT = "id string, bio string, followers_count long, following_count long, fetched boolean"
POST = "id string, account_id string, at_us long, is_reply boolean, is_retweet boolean, in_reply_to string, text string"
HOUR = 3_600_000_000


def test_fixed_decimals_round_the_stored_value(spark):
    rng = random.Random(1)
    values = [0.0, 0.075, 0.125, 0.375, 1.005, 2.675, 0.995, 0.9999, 1 / 3, 0.0005, 12345.125, -0.125, -0.001, 99.5, *(rng.random() * 10 ** rng.randint(-3, 4) for _ in range(300)), *(k / 200 for k in range(200))]
    for digits in (0, 2, 3):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(text.fixed(F.col("v"), digits)).collect()]
        want = [str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        assert got == [re.sub(r"^-(0(\.0*)?)$", r"\1", w) for w in want]


def test_contexts_count_utf16_units(spark):
    row = spark.createDataFrame([("🎉ab稼げる🎉🎉x稼げるend",), ("nothing",), (None,)], "t string").select(text.contexts(F.col("t"), "稼げる", 2, 3).alias("c")).collect()
    assert [tuple(m) for m in row[0]["c"]] == [(3, "稼げる", "ab", "🎉"), (9, "稼げる", "x", "end")]  # half a party popper is none
    assert row[1]["c"] == [] and row[2]["c"] is None
    at = spark.createDataFrame([("x" * 59 + "🆖",), ("x" * 58 + "🆖",)], "t string").select(text.first_units(F.col("t"), 60)).collect()
    assert [r[0] for r in at] == ["x" * 59, "x" * 58 + "🆖"]


SOLICITING = ("dm me for some fun ! 出会い活してます", "自動フォローで繋がりましょう！稼げる情報も発信", "ＦＯＬＬＯＷ FOR follow", "出会い系はお断り。" + "本と音楽と旅が好きです。" * 6 + "副業の紹介します", "副業、紹介" + "🎉" * 3 + "不労所得", "裏垢のDM募集")
REFUSING = ("相互フォロー大歓迎！フォロバします。無言フォローご自由に。DMください。", "投資や副業、アルバイト勧誘、出会い系といったフォローはお断りです。", "宣伝目的、出会い系は固く御断りします", "副業🆖❌趣味のお友達募集中！", "出会い系のフォロー要らんよ😅", "出会い系ﾀﾞﾒ", "パパ活ママ活は通報", "Developer.", "", None)


def test_solicitations_and_refusals(spark):
    rows = [(str(i), b) for i, b in enumerate(SOLICITING + REFUSING)]
    got = spark.createDataFrame(rows, "id string, bio string").select("id", text.nfkc("bio").alias("bio")).select("id", solicitation.solicits(F.col("bio")).alias("v")).collect()
    assert {int(r["id"]) for r in got if r["v"]} == set(range(len(SOLICITING)))


def spam_of(spark, followers, following, bio, posts=(), fetched=True):
    rows = [(str(i), "a", i, False, rt, None, t) for i, (rt, t) in enumerate(posts)]
    return solicitation.spam(spark.createDataFrame([("a", bio, followers, following, fetched)], ACCOUNT), spark.createDataFrame(rows, POST)).first()


def test_spam_rule(spark):
    asks = SOLICITING[0]
    r = spam_of(spark, 10, 800, asks)
    assert (r["value"], r["confidence"]) == (True, 0.8) and r["reason"] == "bio solicitation=true, tweetSolicitationCount=0, retweetRatio=0.00 (n=0), followingCount=800, followersCount=10"
    assert not spam_of(spark, 10, 800, REFUSING[0])["value"] and not spam_of(spark, 500, 400, asks)["value"]
    assert spam_of(spark, 500, 400, asks, [(True, "RT @x: y")] * 5)["value"]
    assert not spam_of(spark, 500, 400, asks, [(True, "RT")] * 4)["value"]  # too few posts
    twice = [(False, "稼げる"), (False, "副業で紹介"), (True, "稼げる")]
    assert spam_of(spark, 0, 600, None, twice)["value"] and not spam_of(spark, 0, 600, None, twice, fetched=False)["value"] and not spam_of(spark, 0, 600, None, twice[1:])["value"]
    both = spam_of(spark, 10, 800, None, [(True, "RT")] * 9 + [(False, "x")])
    assert (both["value"], both["confidence"]) == (True, 0.75) and "retweetRatio=0.90 (n=10)" in both["reason"]
    assert spam_of(spark, 0, 0, None)["confidence"] == 1.0


def plain_bigrams(t):
    units = t.encode("utf-16-le")
    pairs = {units[i : i + 4] for i in range(0, len(units) - 2, 2)}
    return pairs or ({units} if units else set())


def plain_average(texts):
    total = pairs = 0
    sets = [plain_bigrams(t or "") for t in texts]
    for i in range(len(sets)):
        for j in range(i):
            pairs += 1
            total += len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0
    return total / pairs if pairs else 0.0


@pytest.mark.parametrize("block", [512, 3])
def test_average_likeness_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", block)
    rng = random.Random(5)
    groups = {g: ["".join(rng.choice("ab日🎉 ") for _ in range(rng.randint(0, 12))) for _ in range(n)] for g, n in (("a", 40), ("b", 1), ("c", 2), ("d", 17))}
    groups["a"] += [groups["a"][0]] * 5 + [None, "", "x", "x"]
    df = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "grp string, text string")
    got = {r["grp"]: (r["n"], r["similarity"]) for r in similarity.average_likeness(df).collect()}
    assert got == {g: (len(ts), pytest.approx(plain_average(ts), abs=1e-12)) for g, ts in groups.items()}
    assert similarity.average_likeness(df.limit(0)).count() == 0


def test_a_hot_group_is_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 64)
    df = spark.range(1000).select(F.lit("hot").alias("grp"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    real, sizes = similarity._tile, spark.sparkContext.accumulator(0)

    def tile(batch):
        assert batch.num_rows <= 2 * 64 * 2
        sizes.add(1)
        return real(batch)

    monkeypatch.setattr(similarity, "_tile", tile)
    r = similarity.average_likeness(df).first()
    assert r["n"] == 1000 and sizes.value == 16 * 16
    assert r["similarity"] == pytest.approx(plain_average([f"text number {i}" for i in range(1000)]), abs=1e-9)


def normal(t):
    return re.sub(r"\s+", " ", re.sub(r"@[A-Za-z0-9_]+", "", re.sub(r"https?://\S+", "", t))).strip().lower()


def plain_first(replies):
    out = {}
    for id_, account, at, target, t in sorted(replies, key=lambda r: (r[2] // 1000, [-ord(c) for c in r[0]])):
        if target is not None and len(normal(t).encode("utf-16-le")) // 2 >= 20:
            out.setdefault(target, {}).setdefault(account, (at // 1000, normal(t)))
    return out


def plain_swarm(entries):
    times = [t for t, _ in entries.values()]
    return len(entries) >= 5 and max(times) - min(times) <= 24 * 3600 * 1000 and round(plain_average([x for _, x in entries.values()]), 12) >= 0.1


def crowd(seed=7):
    rng, out = random.Random(seed), []
    for i in range(260):
        target = rng.choice(["near", "far", "unlike", "small", "edge", None])
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) if target == "unlike" else f"@host what a wonderful photo of it 🎉 {rng.randrange(9)}"
        t = t if target == "unlike" else rng.choice([t, t, t, "short one", "🎉" * 10])
        at = rng.randrange(40 if target == "far" else 20) * HOUR + rng.randrange(3) * 500
        out.append((f"r{i:03d}", f"u{rng.randrange(4 if target == 'small' else 12)}", at, target, t))
    return [r for r in out if r[3] != "edge"] + [(f"e{i}", f"u{i}", (24 * HOUR if i == 4 else 0), "edge", f"what a wonderful photo of it {i}") for i in range(5)]


REPLY = "id string, account_id string, at_us long, target string, text string"


def test_swarm_index_and_sizes(spark):
    rows = crowd()
    first = swarms.first_replies(spark.createDataFrame(rows, REPLY))
    want = plain_first(rows)
    assert {(r["target"], r["account_id"]): (r["ms"], r["text"]) for r in first.collect()} == {(t, a): e for t, own in want.items() for a, e in own.items()}
    index = {r["target"]: r for r in swarms.swarm_index(first).collect()}
    assert {t: r["swarm"] for t, r in index.items()} == {t: plain_swarm(own) for t, own in want.items()}
    assert index["near"]["swarm"] and index["edge"]["swarm"] and not (index["far"]["swarm"] or index["unlike"]["swarm"] or index["small"]["swarm"])
    assert index["near"]["similarity"] == pytest.approx(plain_average([x for _, x in want["near"].values()]), abs=1e-12)
    sizes = {r["account_id"]: r["size"] for r in swarms.swarm_sizes(first, swarms.swarm_index(first)).collect()}
    assert sizes == {a: max(len(own) for t, own in want.items() if a in own and plain_swarm(own)) for own in want.values() if plain_swarm(own) for a in own}


def test_the_augmented_index_equals_one_built_again(spark):
    rows, rng = crowd(), random.Random(3)
    own = [(f"n{i}", rng.choice([f"u{rng.randrange(12)}", "new1", "new2"]), rng.randrange(-6, 30) * HOUR, rng.choice(["near", "far", "small", "edge", "unlike", "unseen"]), rng.choice([f"what a wonderful photo of it {rng.randrange(20)}", "another text that is quite different", "short"])) for i in range(60)]
    first = kept(swarms.first_replies(spark.createDataFrame(rows, REPLY)))
    got = {(r["account_id"], r["target"]): (r["authors"], r["swarm"]) for r in swarms.augmented(first, kept(swarms.swarm_index(first)), spark.createDataFrame(own, REPLY)).collect()}
    base, want = plain_first(rows), {}
    for target, entries in plain_first(own).items():
        for account, entry in entries.items():
            now = dict(base.get(target, {}))
            if account not in now or entry[0] < now[account][0]:
                now[account] = entry
            want[account, target] = (len(now), plain_swarm(now))
    assert got == want and {True, False} == {s for _, s in want.values()}


def test_swarm_rule_needs_a_sample_of_replies(spark):
    accounts = spark.createDataFrame([("a", None, 0, 0, True), ("b", None, 0, 0, False), ("c", None, 0, 0, True), ("d", None, 0, 0, True)], ACCOUNT)
    posts = spark.createDataFrame([(f"{a}{i}", a, i, i < n, False, None, "x") for a, n in (("a", 3), ("b", 3), ("c", 1)) for i in range(3)], POST)
    sizes = spark.createDataFrame([("a", 6), ("b", 6), ("c", 9)], "account_id string, size long")
    got = {r["account_id"]: (r["value"], r["confidence"], r["evaluable"], r["reason"]) for r in swarms.swarm_rule(accounts, posts, sizes).collect()}
    assert got == {
        "a": (True, 0.6, True, "replyHijackSwarmSize=6, replyRatio=1.00 (n=3)"), "b": (False, 0.5, False, "replyHijackSwarmSize=6, replyRatio=1.00 (n=3)"),
        "c": (False, 1 - round(0.5 + (1 / 3 - 0.5), 6), True, "replyHijackSwarmSize=9, replyRatio=0.33 (n=3)"), "d": (False, 0.5, False, "replyHijackSwarmSize=0, replyRatio=0.00 (n=0)"),
    } or got["c"][1] == pytest.approx(2 / 3, abs=1e-6)


FLOODED = ("この動画おもしろすぎて何回も見ちゃった 😂", "何回見てもこの動画おもしろすぎる 😂", "この動画ほんとにおもしろい、笑いが止まらない 💀", "こんなにおもしろい動画は久しぶりに見た 😭", "おもしろすぎて友達にもこの動画を送っちゃった 😂", "この動画、何回も見てるけどやっぱりおもしろい 👀", "こんな動画は見たことない、おもしろすぎる 💀", "この動画のおもしろさは何回見ても変わらない 😭")


def flood_of(spark, texts, hours=1, retweet=False, target="t"):
    rows = [(f"r{i}", "a", int(i * hours * HOUR / max(1, len(texts) - 1)), True, retweet, target, t) for i, t in enumerate(texts)]
    return swarms.flooding_rule(spark.createDataFrame([("a", None, 0, 0, True)], ACCOUNT), spark.createDataFrame(rows, POST)).first()


def test_flooding_rule(spark):
    r = flood_of(spark, [f"@star {t}" for t in FLOODED])
    like = plain_average([normal(t) for t in FLOODED])
    assert r["value"] and r["reason"] == f"target=@star, replies=8, avgSimilarity={like:.3f}"
    assert r["confidence"] == pytest.approx(0.4 * 0.5 + 0.6 * min(1, 0.5 + (like - 0.03) * 0.5 / 0.12), abs=1e-6)
    assert flood_of(spark, FLOODED[:7])["reason"] == "no reply-flooding target found"
    assert not flood_of(spark, FLOODED, hours=25)["value"] and not flood_of(spark, FLOODED, retweet=True)["value"] and not flood_of(spark, FLOODED, target=None)["value"]
    assert not flood_of(spark, [f"{c} #live" for c in "山川田木空海花雪"])["value"]  # tags don't count
    assert not flood_of(spark, [f"{c}{c} running gag" for c in "山川田木空海花雪"])["value"]  # nor words that most have
    assert flood_of(spark, ["all the same"] * 9)["reason"] == "target=@unknown, replies=9, avgSimilarity=1.000"


def test_nfkc(spark):
    values = ["ﾀﾞﾒ", "ｆ４ｆ", "①", "ガ", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(text.nfkc("v")).collect()]
    assert got == [v and unicodedata.normalize("NFKC", v) for v in values]
