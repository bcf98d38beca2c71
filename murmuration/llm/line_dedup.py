"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct lower-cased words, ordered by rarity in the corpus. Lines with equal sets
are one node at its first place. Similar lines (Jaccard 0.8 or more) share a token among the first few of
each, the prefix; where that token is a frequent one, they also share a second token behind it, and the
two together are the key on which lines meet. Lines that meet pass the length filter, the positional
filter, and a filter on parities of their sets (128 bits, of long lines 256), all without loss; what is
left is verified on the words themselves. Parities are that wide as narrower ones tell nothing of lines
with about as many words: pairs of them would grow with the square of the lines. A line goes when a line
before it is similar.

Each node is first compared with the earliest node of a few of its keys, which settles large groups of
alike lines. Only nodes that this left unsettled meet all lines before them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small, spool, text_or_empty

#: Similarity in percent.
SIMILAR = 80
#: Lines with a word.
WORDED = r"[^\x20\x09-\x0D]"
#: Counts of words are known by hash bucket, less what an ordinary bucket holds, in CLASS_STEPS classes for
#: each doubling and 127 at most. They bear on cost alone, as do the words that count as FREQUENT.
BUCKETS, CLASS_STEPS, FREQUENT = 1 << 17, 6, 3000
#: Sets of more words have parities of four longs, others of two and zeros. They bear on cost alone.
LONG = 128
PARITIES = tuple(f"parity{i}" for i in range(4))
SPACE = r"[\x20\x09-\x0D]+"
#: Sets of so few words are similar to equal sets alone.
ALONE = 3


def needed(n: Column) -> Column:
    """The least overlap of a set of n with a similar one."""
    return F.ceil(n * SIMILAR / 100)


def worded_lines(lines: DataFrame) -> DataFrame:
    """`lines` (body and others) with words (lower case, by white space) in place of body, for those that have a word."""
    body = F.col("body")
    uneven = body.contains("  ") | body.startswith(" ") | body.endswith(" ")
    for space in "\t\x0b\x0c\r":
        uneven = uneven | body.contains(space)
    even = F.when(uneven, F.trim(F.regexp_replace("body", SPACE, " "))).otherwise(body)
    return lines.where(body.rlike(WORDED)).select(*[c for c in lines.columns if c != "body"], F.split(F.lower(even), " ").alias("words"))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc, row, line, body of rows (doc, row, text)."""
    return docs.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def hashes() -> Column:
    """Hashes of the distinct words, ascending."""
    return F.sort_array(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))))


def steps(count: float) -> int:
    return min(127, int(CLASS_STEPS * math.log2(max(1.0, count))))


def rarity(docs: DataFrame) -> list[int]:
    """The class of each hash bucket of words. A quarter of the buckets have no more than the count that is taken off: the rare words that share each bucket."""
    words = docs.select(F.explode(F.split(F.lower("text"), SPACE)).alias("w"))
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    found = counts.toPandas().set_index("b")["n"].reindex(range(BUCKETS), fill_value=0)  # BUCKETS counts at most
    ordinary = float(found.quantile(0.25))
    return [steps(n - ordinary) for n in found]


def ranked(hashes: str, table: list[int]) -> Column:
    """Longs that sort by class, then by hash (the 56 bits of it that are left)."""
    classes = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")  # folded to a constant
    key = lambda w: F.shiftleft(F.get(classes, w.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(w, 8))
    return F.sort_array(F.transform(hashes, key))


def parities() -> list[Column]:
    """Four longs for sets of more than LONG words; for others their folds, two longs, and zeros. Each word flips one bit."""
    flip = lambda mine: F.aggregate("hashes", F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(F.call_function("shiftleft", mine(w), F.shiftrightunsigned(w, 50).cast("int"))))  # noqa: E731  (a long is shifted by the six lowest bits)
    quarter = lambda i: flip(lambda w: (F.shiftrightunsigned(w, 62) == i).cast("long"))
    halves = {0: flip(lambda w: F.shiftrightunsigned(F.bitwise_not(w), 63)), 2: flip(lambda w: F.shiftrightunsigned(w, 63))}
    return [F.when(F.col("n") > LONG, quarter(i)).otherwise(halves.get(i, F.lit(0).cast("long"))).alias(c) for i, c in enumerate(PARITIES)]


def described(docs: DataFrame, table: list[int]) -> DataFrame:
    """One row for each line with a word: id, doc, row, line, node (hash of its set), n (words), PARITIES (each bit: whether an odd
    number of words hash to it), prefix (one token more than the shortest prefix that can't miss; null where equal sets alone are similar), marks (of the
    two words with the least hashes, and of those with the greatest: similar sets mostly share one, wherever they differ)."""
    own = worded_lines(split_lines(docs)).withColumn("hashes", hashes()).withColumn("n", F.size("hashes"))
    prefix = F.when(F.col("n") > ALONE, F.slice(ranked("hashes", table), F.lit(1), (F.col("n") - needed(F.col("n")) + 2).cast("int")))
    return spool(own.select(F.monotonically_increasing_id().alias("id"), "doc", "row", "line", F.xxhash64("hashes").alias("node"), "n", *parities(), prefix.alias("prefix"), F.array(F.xxhash64(F.slice("hashes", 1, 2)), F.xxhash64(F.slice("hashes", F.greatest(F.col("n") - 1, F.lit(1)), F.lit(2)))).alias("marks")), "lines")


def most_apart() -> Column:
    """In so many words two similar sets (n_a, n_b) differ at most."""
    return F.col("n_a") + F.col("n_b") - 2 * F.ceil((F.col("n_a") + F.col("n_b")) * SIMILAR / (100 + SIMILAR) - 1e-6)


def bits_apart(folded: bool = True) -> Column:
    """Bits in which the two sets' parities differ, never more than the sets differ in words. Unless folded to two longs they say so of two sets of more than LONG words alone."""
    differ = [F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in PARITIES]
    longs = [differ[0].bitwiseXOR(differ[1]), differ[2].bitwiseXOR(differ[3])] if folded else differ
    return sum((F.bit_count(x) for x in longs[1:]), F.bit_count(longs[0]))


def may_be_similar() -> Column:
    """Neither the lengths nor the parities, which differ in no more bits than the sets in words, rule it out."""
    fitting = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR
    both_long = F.least("n_a", "n_b") > LONG
    return fitting & (bits_apart() <= most_apart()) & (~both_long | (bits_apart(folded=False) <= most_apart()))


def earlier() -> Column:
    """b is before a, null ids first."""
    place = lambda x: F.struct(F.col(f"doc_{x}").alias("d"), F.col(f"line_{x}").alias("l"))
    return place("b") < place("a")


def keys() -> Column:
    """The keys of a line with their positions: each token of the shortest prefix, or, if it is frequent, its pairs with each later token of `prefix`."""
    frequent = lambda t: F.shiftright(t, 56) >= steps(FREQUENT)
    rest = lambda i: F.slice("prefix", i + 2, F.greatest(F.size("prefix") - i - 1, F.lit(0)))
    each = lambda t, i: F.when(frequent(t), F.transform(rest(i), lambda u: F.struct(F.xxhash64(t, u).alias("key"), i.alias("pos")))).otherwise(F.array(F.struct(t.alias("key"), i.alias("pos"))))
    return F.flatten(F.transform(F.slice("prefix", F.lit(1), F.size("prefix") - 1), each))


def named(df: DataFrame, x: str, *same: str) -> DataFrame:
    return df.select(*[F.col(c) if c in same else F.col(c).alias(f"{c}_{x}") for c in df.columns])


def sets_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """node and body of the lines at `places`, from the texts again."""
    wanted = spool(places.groupBy("doc", "row").agg(F.collect_set("line").alias("wanted")), "wanted")  # of one text's lines
    wanted = wanted.select(F.col("doc").alias("d"), F.col("row").alias("r"), "wanted")
    held = docs.join(small(wanted), F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    bodies = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains("wanted", i), x)), lambda x: x.isNotNull())
    found = held.select(F.explode(bodies).alias("body"))
    nodes = worded_lines(found.select("body", F.col("body").alias("own"))).withColumn("hashes", hashes())
    sets = nodes.select(F.xxhash64("hashes").alias("node"), F.col("own").alias("body"))
    return spool(sets.dropDuplicates(["node"]), "sets")


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """node: the distinct node_a of those `pairs` whose words are similar."""
    bodies = sets.select("node", "body")
    whole = pairs.select("node_a", "node_b").join(named(bodies, "a"), "node_a").join(named(bodies, "b"), "node_b")
    for x in "ab":
        whole = worded_lines(whole.withColumnRenamed(f"body_{x}", "body")).withColumn(f"words_{x}", F.array_distinct("words")).drop("words")
    both = F.size(F.array_intersect("words_a", "words_b"))
    sized = whole.select("node_a", both.alias("both"), (F.size("words_a") + F.size("words_b")).alias("sum"))
    return spool(sized.where(f"100 * both >= {SIMILAR} * (sum - both)").select(F.col("node_a").alias("node")).distinct(), "similar")


def verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """node: those of the later line in each of `pairs` (id_a, id_b, bits) whose words are similar to the earlier one's.

    The likeliest one of each line (the fewest bits apart) is verified first, then the others of lines that this didn't settle.
    """
    ends = spool(pairs.selectExpr("id_a AS id").unionByName(pairs.selectExpr("id_b AS id")).distinct(), "ends")
    places = spool(lines.select("id", "node", "doc", "row", "line").join(small(ends), "id"), "places")
    placed = pairs.join(small(named(places, "a")), "id_a").join(small(named(places, "b")), "id_b")
    swap = lambda x, y: F.when(earlier(), F.col(x)).otherwise(F.col(y)).alias(x)
    apart = ~F.col("doc_a").eqNullSafe(F.col("doc_b")) | (F.col("line_a") != F.col("line_b"))
    near = spool(placed.where(apart).select(swap("node_a", "node_b"), swap("node_b", "node_a"), "bits"), "near")
    sets = sets_of(docs, places)
    best = spool(near.groupBy("node_a").agg(F.min(F.struct("bits", "node_b")).alias("best")).select("node_a", "best.node_b"), "best")
    settled = similar(sets, best)
    rest = near.join(small(settled.select(F.col("node").alias("node_a"))), "node_a", "left_anti")
    return settled.unionByName(similar(sets, rest.join(best, ["node_a", "node_b"], "left_anti")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row, line: the lines of `docs` that go, as an earlier line (smaller id, or smaller number in the same text) is equal or similar.

    Lines end at line feeds and have numbers from 0. Lines without words (empty, white space) never
    go; null and empty texts have none other. Null ids come first. Rows that share an id stand at the
    same places: neither is before the other; `row`, a hash of the text, tells them apart. An earlier line
    counts even when it goes itself. Very long texts and lines are taken whole. Nodes are 64-bit hashes of word sets.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text"))
    lines = described(docs, rarity(docs))

    # Of lines with equal sets the first one stands for all.
    repeated = spool(lines.groupBy("node").agg(F.count("*").alias("copies")).where("copies > 1").select("node"), "repeated")
    firsts = lines.join(small(repeated), "node").groupBy("node").agg(F.min(F.struct("doc", "line", "id")).alias("first"))
    firsts = spool(firsts.select("node", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"), F.col("first.id").alias("first_id")), "repeats")
    nodes = lines.where("prefix IS NOT NULL").join(small(firsts.select("node", "first_id")), "node", "left").where("first_id IS NULL OR id = first_id")

    # The last token of each prefix and the marks, and the earliest line and those just before for each. Tokens alone don't do:
    # a line with many rare words of its own has others in its prefix than the lines that it is similar to.
    own = ("id", "doc", "line", "n", *PARITIES)
    few = F.array_distinct(F.concat(F.array(F.get("prefix", F.size("prefix") - 2)), "marks"))
    by_key, other = Window.partitionBy("key").orderBy("doc", "line", "id"), F.struct(*own)
    others = F.array(F.first(other).over(by_key), *[F.lag(other, k).over(by_key) for k in (1, 2, 5)])
    met = nodes.select(*own, F.explode(few).alias("key")).withColumn("others", F.array_distinct(F.array_compact(others)))
    met = met.select(*[F.col(c).alias(f"{c}_a") for c in own], F.explode("others").alias("other"))
    met = met.select("*", *[F.col(f"other.{c}").alias(f"{c}_b") for c in own]).where(earlier() & may_be_similar()).select("id_a", "id_b", bits_apart().alias("bits")).distinct()
    settled = verified(docs, lines, spool(met, "firsts"))

    # What its keys' earliest lines did not settle meets all others.
    left = nodes.join(small(settled.withColumn("settled", F.lit(True))), "node", "left")
    entries = left.select("id", "doc", "n", *PARITIES, F.col("settled").isNull().alias("open"), F.explode(keys()).alias("k"))
    entries = entries.select("k.key", "id", "doc", *PARITIES, F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("k.pos").cast("long"), 1)).bitwiseOR(F.col("open").cast("long")).alias("packed")).repartition("key")
    entries = entries.select("key", "id", "doc", *PARITIES, F.shiftright("packed", 32).cast("int").alias("n"), F.shiftright(F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int").alias("pos"), (F.col("packed") % 2 == 1).alias("open"))
    meeting = named(entries, "a", "key").join(named(entries, "b", "key"), "key")
    # No overlap lies before the first shared token. Two open lines of one text meet twice. That a is open is asked
    # together with the positions, of both sides: a filter on one side would make the two sides two exchanges.
    not_later = F.coalesce(F.col("doc_b") <= F.col("doc_a"), F.col("doc_b").isNull())
    reach = F.when(F.col("open_a"), most_apart()).otherwise(-1)
    meeting = meeting.where((F.col("pos_a") + F.col("pos_b") <= reach) & may_be_similar() & not_later & (F.col("id_a") != F.col("id_b")))
    gone = settled.unionByName(verified(docs, lines, spool(meeting.select("id_a", "id_b", bits_apart().alias("bits")).distinct(), "others"))).distinct()

    # Lines with equal sets go with, and after, their first place.
    gone = spool(gone, "gone").withColumn("gone", F.lit(True))
    fates = spool(firsts.drop("first_id").join(gone, "node", "full_outer"), "fates")
    at_first = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))
    return lines.select("node", "doc", "row", "line").join(small(fates), "node").where(F.col("gone") | ~at_first).select("doc", "row", "line").distinct()


def with_removed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with __gone: the numbers of its lines that go, ascending, or null."""
    gone = removed_lines(docs, id_col, text_col).groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_set("line")).alias("__gone"))  # of one text's lines
    same = F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__row"))
    return docs.join(gone, same, "left").drop("__doc", "__row")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with their columns, without the lines that go (see removed_lines).

    A text of which no line stays goes too; one without lines to look at stays as it is (null, empty). Rows
    repeated whole are treated alike. An empty table gives an empty one. Other columns are kept as
    they are, whatever their names but __doc, __row, __gone and __rest.
    """
    kept = with_removed(docs, id_col, text_col)
    rest = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("__gone", i))
    kept = kept.withColumn("__rest", F.when(F.col("__gone").isNotNull(), rest))
    some = F.exists("__rest", lambda x: F.trim(x) != "")
    columns = [F.when(F.col("__rest").isNull(), F.col(text_col)).otherwise(F.array_join("__rest", "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return kept.where(F.col("__rest").isNull() | some).select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that go, comma-joined), one row for each document."""
    rows = with_removed(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return rows.select(
        "doc_id",
        F.size(F.split(text_or_empty(), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("__gone", ","), F.lit("")).alias("removed"),
    )
