"""Queries of the rules on bios, replies and swarms, and the same in DuckDB SQL, written from the rules and not from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import behaviour, similarity, solicitation, swarms
from ..sources import adapters, signals
from ..sources.kept import kept

RECENT = 20


def spam_rule(spark, d):
    return solicitation.spam(signals.account(spark, d), behaviour.recent(signals.bait(spark, d), RECENT))


def solicitation_contexts(spark, d):
    """What stands 12 characters before and behind each soliciting phrase of the bios."""
    bios = signals.account(spark, d).select("id", text.nfkc("bio").alias("bio"))
    rows = bios.select("id", F.explode(text.contexts(F.col("bio"), solicitation.SOLICITATION, 12, 12)).alias("m"))
    return rows.select("id", "m.start", "m.match", "m.before", "m.after")


def group_similarity(spark, d):
    """Of each conversation, how like its turns are."""
    rows = adapters.table(spark, d, "conversations").select(F.col("conv_id").alias("grp"), text.normalize_for_similarity(F.coalesce("text", F.lit(""))).alias("text"))
    return similarity.average_likeness(rows).select("grp", "n", F.round("similarity", 6).alias("similarity"))


def _crowd(spark, d, measured=True):
    first = kept(swarms.first_replies(signals.crowd(spark, d).where("is_reply")))
    return first, kept(swarms.swarm_index(first, measured))


def reply_swarms(spark, d):
    _, index = _crowd(spark, d)
    return index.select("target", "authors", ((F.col("most") - F.col("least")) / 1000).cast("long").alias("span_s"), F.when(F.col("most") - F.col("least") <= swarms.WINDOW_MS, F.round("similarity", 6)).alias("similarity"), "swarm")


def reply_hijack_swarm(spark, d):
    recent = behaviour.recent(signals.crowd(spark, d), RECENT)
    return swarms.swarm_rule(signals.account(spark, d), recent, swarms.swarm_sizes(*_crowd(spark, d, measured=False)))


def augmented_swarms(spark, d):
    rows = swarms.augmented(*_crowd(spark, d, measured=False), signals.newcomers(spark, d))
    return rows.select("account_id", "target", "authors", F.when(F.col("swarm"), F.round("similarity", 6)).alias("similarity"), "swarm")


def reply_flooding(spark, d):
    return swarms.flooding_rule(signals.account(spark, d), behaviour.recent(signals.flood(spark, d), RECENT))


QUERIES = {f.__name__: f for f in (spam_rule, solicitation_contexts, group_similarity, reply_swarms, reply_hijack_swarm, augmented_swarms, reply_flooding)}

# The bios with compatibility forms composed by hand.
_ACCOUNT = """a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, (['出会い活してます dm me for some fun !', '投資や副業、出会い系といったフォローはお断りです。', '出会い系ダメ!日常の記録', '副業🆖❌趣味のお友達募集中!', '副業で友だち紹介、高収入なバイト', 'f4f! follow for follow',
 'just here to read the news', NULL, 'パパ活お断り。' || repeat('写真と散歩と読書が好きです。', 5) || '稼げる情報を発信', '裏垢さん達のDM募集は通報します', '不労所得' || repeat('X🎉', 15) || 'NG', '不労所得' || repeat('あ🎉', 21) || 'NG'])[c_custkey % 12 + 1] AS bio,
 ([10, 500, 500, 0])[c_custkey % 4 + 1] AS followers_count, ([800, 400, 2000, 620])[c_custkey % 4 + 1] AS following_count, c_custkey % 11 <> 0 AS fetched FROM customer)"""
_SOLICITS = r"(?i)出会い(?:系|活)|パパ活|ママ活|裏垢.{0,10}(?:dm|DM|募集|販売)|自動(?:フォロー|いいね)|稼げる|副業[^\s❌🆖✗・、。!！🚫🈲]{0,10}(?:募集|紹介|稼)|儲かる|不労所得|高収入.{0,10}(?:バイト|副業)|f4f|follow\s*for\s*follow|dm\s*me.{0,10}fun"
_REFUSES = r"(?i)お断り|お断わり|御断り|拒否|NG|ダメ|禁止|お控え|ご遠慮|しないで|通報|ブロック|スルー|無視|要らん|要りません|要らない|いりません|いらない|不要|結構です|興味(?:が)?(?:あり|有り)?ません|対応(?:は)?していません|受け?付け?(?:は)?(?:して)?(?:い|おり)?ません|🆖|❌|✗"
# One match after the other: what is left of the text behind each.
_MATCHES = """m AS (SELECT {key}, txt, txt AS rest, 0 AS gone, NULL::VARCHAR AS hit, 0 AS start FROM {rows} WHERE txt IS NOT NULL
 UNION ALL SELECT {key}, txt, substr(rest, strpos(rest, h) + length(h)), gone + strpos(rest, h) - 1 + length(h), h, gone + strpos(rest, h) - 1 FROM (SELECT *, regexp_extract(rest, '{pattern}') AS h FROM m) WHERE h <> '')"""
_AHEAD = "replace(substr(regexp_replace(substr(rest, 1, 60), '([\\x{10000}-\\x{10FFFF}])', '☐\\1', 'g'), 1, 60), '☐', '')"
_RECENT = "(SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY at_us DESC, id DESC) AS place FROM {0}) WHERE place <= 20"
_EVENT = "CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS account_id, epoch_us(ts) AS at_us"
_BAIT = f"""b AS (SELECT {_EVENT}, CASE WHEN user_id % 3 = 0 THEN event_id % 10 <> 0 ELSE event_id % 3 = 0 END AS is_retweet,
 CASE WHEN user_id % 5 = 0 THEN (['今だけ稼げる方法', '稼げる話は興味ありません', '自動フォローで相互に', '朝ごはん'])[event_id % 4 + 1] ELSE '日記 ' || event_id END AS txt FROM events)"""
_RAMP = "greatest(0, least(1, 0.5 + ({0} - {1}) * 0.5 / {2}))"
_CROWD = f"""c AS (SELECT {_EVENT}, event_id, epoch_us(ts) // 43200000000 AS half, event_id % 5 <> 0 AS is_reply,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'long-' || (event_id % 3) ELSE 't' || (epoch_us(ts) // 43200000000) END AS target,
 CASE epoch_us(ts) // 43200000000 % 3 WHEN 0 THEN '@host What a wonderful photo of the old harbour, number ' || (event_id % 7) WHEN 1 THEN md5(CAST(event_id AS VARCHAR)) ELSE 'nice ' || event_id END AS txt FROM events)"""
_PLAIN = "trim(lower(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://\\S+', '', 'g'), '@\\w+', '', 'g'), '\\s+', ' ', 'g')))"
_PAIRS = "CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"
_FIRST = f"""f AS (SELECT target, account_id, at_us // 1000 AS ms, x, {_PAIRS.format("x")} AS g FROM (SELECT *, {_PLAIN.format("txt")} AS x, row_number() OVER (PARTITION BY target, account_id ORDER BY at_us // 1000, id DESC) AS place
 FROM (SELECT * FROM c WHERE is_reply AND target IS NOT NULL AND length({_PLAIN.format("txt")}) >= 20)) WHERE place = 1)"""
_LIKE = "len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g)))"
_SWARMS = f"""r AS (SELECT target, count(*) AS authors, max(ms) - min(ms) AS span FROM f GROUP BY 1),
 w AS (SELECT p.target, avg({_LIKE}) AS s FROM f p JOIN f q ON p.target = q.target AND p.account_id < q.account_id JOIN r ON r.target = p.target WHERE r.authors >= 4 AND r.span <= 86400000 GROUP BY 1),
 z AS (SELECT target, authors, span, s, authors >= 5 AND span <= 86400000 AND coalesce(round(s, 12), 0) >= 0.1 AS swarm FROM r LEFT JOIN w USING (target))"""
_FLOOD = f"""p AS (SELECT {_EVENT.replace("epoch_us(ts) AS at_us", "CASE WHEN user_id % 2 = 0 THEN 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60 ELSE epoch_us(ts) END AS at_us")}, event_id % 7 <> 0 AS is_reply, event_id % 7 = 1 AS is_retweet,
 CASE WHEN event_id % 10 = 2 THEN NULL WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS target,
 CASE user_id % 3 WHEN 0 THEN (['@star この動画 おもしろすぎて何回も見ちゃった #動画', '@star 何回見ても この動画 おもしろすぎる', 'この動画 ほんとにおもしろい https://x.example/a', '@star この動画 は久しぶりに笑った'])[event_id % 4 + 1]
 WHEN 1 THEN substr('山川田木空海花雪月星風火水土石金草竹糸貝', CAST(event_id % 20 + 1 AS INTEGER), 1) ELSE '@a reply ' || (event_id % 9) END AS txt FROM events)"""

ORACLE_SQL = {
    "solicitation_contexts": f"""WITH RECURSIVE {_ACCOUNT}, {_MATCHES.format(key="id", rows="(SELECT id, bio AS txt FROM a)", pattern=_SOLICITS)}
 SELECT id, CAST(start AS INTEGER) AS start, hit AS match,
 replace(right(regexp_replace(right(substr(txt, 1, start), 12), '([\\x{{10000}}-\\x{{10FFFF}}])', '\\1☐', 'g'), 12), '☐', '') AS before, replace(substr(regexp_replace(substr(rest, 1, 12), '([\\x{{10000}}-\\x{{10FFFF}}])', '☐\\1', 'g'), 1, 12), '☐', '') AS after FROM m WHERE hit IS NOT NULL""",
    "spam_rule": f"""WITH RECURSIVE {_ACCOUNT}, {_BAIT}, t AS (SELECT * FROM {_RECENT.format("b")}),
 u AS (SELECT 'a' || id AS k, bio AS txt FROM a UNION ALL SELECT 'p' || id, txt FROM t), {_MATCHES.format(key="k", rows="u", pattern=_SOLICITS)},
 s AS (SELECT k FROM m WHERE hit IS NOT NULL AND NOT regexp_matches({_AHEAD}, '{_REFUSES}') GROUP BY 1),
 n AS (SELECT account_id, count(*) AS n, count(*) FILTER (is_retweet) AS rt, count(*) FILTER (NOT is_retweet AND 'p' || id IN (SELECT k FROM s)) AS found FROM t GROUP BY 1),
 x AS (SELECT a.*, coalesce(n, 0) AS n, 'a' || id IN (SELECT k FROM s) AS asks, CASE WHEN fetched THEN coalesce(found, 0) ELSE 0 END AS found, CASE WHEN coalesce(n, 0) > 0 THEN rt / n ELSE 0.0::DOUBLE END AS ratio FROM a LEFT JOIN n ON n.account_id = a.id),
 y AS (SELECT *, asks OR found >= 2 AS anyway, n >= 5 AND ratio >= 0.8 AS bait, following_count >= 500 AND following_count >= followers_count * 5 AS mass, {_RAMP.format("ratio", "0.8::DOUBLE", "0.2::DOUBLE")} AS r1, {_RAMP.format("following_count", 500, 500.0)} AS r2,
  {_RAMP.format("(CASE WHEN followers_count > 0 THEN following_count / followers_count ELSE following_count END)", 5, 5.0)} AS r3 FROM x),
 v AS (SELECT *, (bait AND mass) OR (anyway AND (bait OR mass)) AS value, greatest(CASE WHEN anyway THEN greatest(r1, least(r2, r3)) ELSE 0 END, least(r1, r2, r3)) AS e FROM y)
 SELECT id AS account_id, 'spam' AS label_key, '1.11.1' AS rule_version, value, round(CAST(CASE WHEN value THEN e ELSE 1 - e END AS DOUBLE), 6) AS confidence, true AS evaluable,
 'bio solicitation=' || asks || ', tweetSolicitationCount=' || found || ', retweetRatio=' || printf('%.2f', ratio + 1e-12) || ' (n=' || n || '), followingCount=' || following_count || ', followersCount=' || followers_count AS reason FROM v""",
    "group_similarity": f"""WITH t AS (SELECT conv_id AS grp, turn, {_PLAIN.format("coalesce(text, '')")} AS x FROM conversations), f AS (SELECT *, {_PAIRS.format("x")} AS g FROM t), n AS (SELECT grp, count(*) AS n FROM f GROUP BY 1),
 w AS (SELECT p.grp, avg(CASE WHEN p.x = '' OR q.x = '' THEN 0 ELSE {_LIKE} END) AS s FROM f p JOIN f q ON p.grp = q.grp AND p.turn < q.turn GROUP BY 1) SELECT grp, n, round(coalesce(s, 0.0), 6) AS similarity FROM n LEFT JOIN w USING (grp)""",
    "reply_swarms": f"WITH {_CROWD}, {_FIRST}, {_SWARMS} SELECT target, authors, span // 1000 AS span_s, round(s, 6) AS similarity, swarm FROM z",
    "reply_hijack_swarm": f"""WITH {_ACCOUNT}, {_CROWD}, {_FIRST}, {_SWARMS}, k AS (SELECT account_id, max(authors) AS size FROM f JOIN z USING (target) WHERE swarm GROUP BY 1), t AS (SELECT * FROM {_RECENT.format("c")}),
 n AS (SELECT account_id, count(*) AS n, count(*) FILTER (is_reply) AS r FROM t GROUP BY 1),
 x AS (SELECT id, fetched, coalesce(n, 0) AS n, coalesce(size, 0) AS size, CASE WHEN coalesce(n, 0) > 0 THEN r / n ELSE 0.0::DOUBLE END AS ratio FROM a LEFT JOIN n ON n.account_id = id LEFT JOIN k ON k.account_id = id),
 y AS (SELECT *, n >= 3 AND fetched AS ok FROM x), v AS (SELECT *, size >= 5 AND ok AND ratio >= 0.5 AS value, least({_RAMP.format("size", 5, 5.0)}, CASE WHEN ok THEN {_RAMP.format("ratio", "0.5::DOUBLE", "0.5::DOUBLE")} ELSE 0 END) AS e FROM y)
 SELECT id AS account_id, 'reply_hijack_swarm' AS label_key, '1.5.0' AS rule_version, value, round(CAST(CASE WHEN NOT ok THEN 0.5 WHEN value THEN e ELSE 1 - e END AS DOUBLE), 6) AS confidence, ok AS evaluable,
 'replyHijackSwarmSize=' || size || ', replyRatio=' || printf('%.2f', ratio + 1e-12) || ' (n=' || n || ')' AS reason FROM v""",
    "augmented_swarms": f"""WITH {_CROWD}, {_FIRST}, o AS (SELECT id, account_id, at_us - (event_id % 3) * 3600000000 AS at_us, 't' || (half + event_id % 2) AS target, txt FROM c WHERE event_id % 17 = 3),
 e AS (SELECT target, account_id, at_us // 1000 AS ms, x, {_PAIRS.format("x")} AS g FROM (SELECT *, {_PLAIN.format("txt")} AS x, row_number() OVER (PARTITION BY target, account_id ORDER BY at_us // 1000, id DESC) AS place FROM (SELECT * FROM o WHERE length({_PLAIN.format("txt")}) >= 20)) WHERE place = 1),
 h AS (SELECT e.target, e.account_id AS candidate, e.account_id, CASE WHEN f.ms <= e.ms THEN f.ms ELSE e.ms END AS ms, CASE WHEN f.ms <= e.ms THEN f.g ELSE e.g END AS g FROM e LEFT JOIN f USING (target, account_id)
  UNION ALL SELECT e.target, e.account_id, f.account_id, f.ms, f.g FROM e JOIN f ON f.target = e.target AND f.account_id <> e.account_id),
 r AS (SELECT target, candidate, count(*) AS authors, max(ms) - min(ms) AS span FROM h GROUP BY 1, 2),
 w AS (SELECT p.target, p.candidate, avg({_LIKE}) AS s FROM h p JOIN h q ON p.target = q.target AND p.candidate = q.candidate AND p.account_id < q.account_id GROUP BY 1, 2),
 z AS (SELECT target, candidate, authors, s, authors >= 5 AND span <= 86400000 AND coalesce(round(s, 12), 0) >= 0.1 AS swarm FROM r LEFT JOIN w USING (target, candidate))
 SELECT candidate AS account_id, target, authors, CASE WHEN swarm THEN round(s, 6) END AS similarity, swarm FROM z""",
    "reply_flooding": f"""WITH {_ACCOUNT}, {_FLOOD}, t AS (SELECT *, at_us // 1000 AS ms FROM {_RECENT.format("p")}), s AS (SELECT * FROM t WHERE is_reply AND NOT is_retweet AND target IS NOT NULL),
 r AS (SELECT account_id, target, count(*) AS replies, max(ms) AS newest, max_by(id, (ms, id)) AS last_id, max_by(txt, (ms, id)) AS shown FROM s GROUP BY 1, 2 HAVING count(*) >= 8 AND max(ms) - min(ms) <= 86400000),
 y AS (SELECT account_id, target, id, {_PLAIN.format("regexp_replace(regexp_replace(regexp_replace(txt, 'https?://\\S+', '', 'g'), '@\\w+', '', 'g'), '#[^\\s#]+', '', 'g')")} AS x FROM s SEMI JOIN r USING (account_id, target)),
 k AS (SELECT account_id, target, id, unnest(string_split(x, ' ')) AS word, generate_subscripts(string_split(x, ' '), 1) AS pos FROM y), n AS (SELECT account_id, target, word FROM k JOIN r USING (account_id, target) WHERE length(word) >= 2 GROUP BY 1, 2, 3, replies HAVING count(DISTINCT id) >= ceil(replies * 0.6::DOUBLE)),
 l AS (SELECT account_id, target, id, string_agg(word, ' ' ORDER BY pos) AS kept FROM k ANTI JOIN n USING (account_id, target, word) WHERE word <> '' GROUP BY 1, 2, 3),
 f AS (SELECT account_id, target, id, x, CASE WHEN x = '' THEN [] ELSE {_PAIRS.format("x")} END AS g FROM (SELECT account_id, target, id, coalesce(kept, x) AS x FROM y LEFT JOIN l USING (account_id, target, id))),
 w AS (SELECT p.account_id, p.target, round(avg(CASE WHEN p.x = '' OR q.x = '' THEN 0 ELSE {_LIKE} END), 12) AS s FROM f p JOIN f q ON p.account_id = q.account_id AND p.target = q.target AND p.id < q.id GROUP BY 1, 2),
 b AS (SELECT account_id, max_by({{'t': target, 'n': replies, 's': s, 'shown': shown}}, (s, newest, last_id)) AS b FROM w JOIN r USING (account_id, target) WHERE s >= 0.03 GROUP BY 1)
 SELECT id AS account_id, 'reply_flooding' AS label_key, '1.4.0' AS rule_version, b IS NOT NULL AS value,
 round(CAST(CASE WHEN b IS NOT NULL THEN 0.4 * {_RAMP.format("b.n", 8, 12.0)} + 0.6 * {_RAMP.format("b.s", "0.03::DOUBLE", "0.12::DOUBLE")} WHEN fetched THEN 1 ELSE 0.5 END AS DOUBLE), 6) AS confidence, b IS NOT NULL OR fetched AS evaluable,
 CASE WHEN b IS NULL THEN 'no reply-flooding target found' ELSE 'target=@' || CASE WHEN regexp_extract(b.shown, '^@(\\w+)', 1) = '' THEN 'unknown' ELSE regexp_extract(b.shown, '^@(\\w+)', 1) END || ', replies=' || b.n || ', avgSimilarity=' || printf('%.3f', b.s + 1e-12) END AS reason
 FROM a LEFT JOIN b ON b.account_id = id""",
}
