"""How like the texts of a group are, for groups of any size.

All pairs of a large group are too many for a task. Its texts are dealt into blocks by hash, and each pair of
blocks is a tile of its own, which counts common bigrams over an inverted list and in bits. Equal texts are one row with a weight.

Where it is only asked whether a large group is like enough, a bound of its mean comes first, from counts that grow with the texts and not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Texts of a block, about.
BLOCK_TEXTS = 4096
#: Bits of a text's position beside a bigram's code, which has CODE_BITS.
OWNER_BITS, CODE_BITS = 30, 33
#: One bit of a pair costs so much less than one entry of an inverted list.
BIT_GAIN = 128
#: Pairs of a strip of a table.
STRIP = 1 << 15
#: Bits of each unit of a bigram that tell its bucket; texts of one count of pairs of buckets, about; texts counted at once; parts of such a count that are sent on their own.
UNIT_BITS, CELL_TEXTS, CELL_STRIP, CELL_PARTS = 5, 1 << 17, 4096, 16
#: Counts of pairs of buckets are floats of 32 bits: what they may lack.
ROUNDING = 1e-3


def bigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code and owner (position in `texts`) of the distinct bigrams of each text, ordered by both; in UTF-16 units, a single unit is its own."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16).astype(np.int64)
    owner, last = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)[sizes > 0] - 1
    code = ((units + 1) << 16) | np.append(units[1:], 0)[: len(units)]
    code[last] = units[last]
    counts = np.ones(len(units), bool)
    counts[last] = sizes[sizes > 0] == 1  # the last unit begins no pair
    both = np.unique((code[counts] << OWNER_BITS) | owner[counts])
    return both >> OWNER_BITS, both & ((1 << OWNER_BITS) - 1)


def likeness_to_all(rows: list[str], columns: list[str], weights: np.ndarray) -> np.ndarray:
    """Of each row the sum of its likeness to the columns by weight: the Jaccard similarity of the bigram sets of each pair; 0 with an empty text.

    Bigrams that few texts share are counted over an inverted list, the others as bits that two texts have in common.
    """
    a, b = len(rows), len(columns)
    code, owner = bigram_codes([*rows, *columns])
    sizes = np.bincount(owner, minlength=a + b)
    starts = np.flatnonzero(np.append(True, np.diff(code) != 0)) if len(code) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(code))[: len(starts)]
    cuts = starts + np.diff(np.append(0, np.cumsum(owner < a))[np.stack([starts, ends])], axis=0)[0]  # owners ascend within a code
    posted = (cuts - starts) * (ends - cuts)
    frequent = posted * BIT_GAIN > a * b
    few = ~frequent & (posted > 0)
    common = np.zeros((a, b) if few.any() else (0, 0), np.int32)
    for start, cut, end in zip(starts[few], cuts[few], ends[few]):
        common[np.ix_(owner[start:cut], owner[cut:end] - a)] += 1
    bit = np.where(frequent, np.cumsum(frequent) - 1, -1)[np.repeat(np.arange(len(starts)), ends - starts)]
    words = np.zeros((-(-int(frequent.sum()) // 64), a + b), np.uint64)
    np.bitwise_or.at(words, (bit[bit >= 0] // 64, owner[bit >= 0]), np.uint64(1) << (bit[bit >= 0] % 64).astype(np.uint64))
    out, step = np.zeros(a), max(1, STRIP // max(1, b))
    for at in range(0, a, step):  # strips of rows that stay in the cache
        end = min(a, at + step)
        strip = common[at:end].astype(np.float64) if len(common) else np.zeros((end - at, b))
        for w in range(0, len(words), 3):  # three words have 192 bits at most, which one byte holds
            found = np.bitwise_count(words[w, None, a:] & words[w, at:end, None])
            for word in words[w + 1 : w + 3]:
                found += np.bitwise_count(word[None, a:] & word[at:end, None])
            strip += found
        union = (sizes[at:end, None] + sizes[None, a:]).astype(np.float64) - strip
        out[at:end] = np.divide(strip, np.maximum(union, 1.0, out=union), out=strip) @ weights
    return out


def paired_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Of the texts at each position, all pairs at once."""
    sides = [(owner << CODE_BITS) | code for code, owner in (bigram_codes(a), bigram_codes(b))]
    sizes = sum(np.bincount(x >> CODE_BITS, minlength=len(a)) for x in sides)
    common = np.bincount(np.intersect1d(*sides, assume_unique=True) >> CODE_BITS, minlength=len(a))
    return common / np.maximum(sizes - common, 1)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two normalised texts; null with a null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), None, object)
    out[known] = paired_likeness(a[known].tolist(), b[known].tolist())
    return pd.Series(out, dtype="float64")


def _tile(batch: pa.Table) -> pa.Table:
    rows = batch.filter(pa.compute.equal(batch.column("side"), 0)).to_pydict()
    columns = batch.filter(pa.compute.equal(batch.column("side"), 1)).to_pydict()
    sums = likeness_to_all(rows["text"], columns["text"], np.array(columns["weight"], float))
    return pa.table({"grp": pa.array(rows["grp"], batch.schema.field("grp").type), "text": pa.array(rows["text"], pa.string()), "part": pa.array(sums, pa.float64())})


def like_sums(texts: DataFrame, members: DataFrame) -> DataFrame:
    """grp, text and total: of each text of `texts` (grp, text; distinct) the sum of its likeness to all of `members` (grp, text, weight).

    Groups that are in one side alone give no row.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    sizes = [df.groupBy("grp").agg(F.count("*").alias("n")).select("grp", blocks.alias(name)) for df, name in ((texts, "down"), (members, "across"))]
    grid = sizes[0].join(sizes[1], "grp")
    own = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = texts.join(grid, "grp").select("grp", "text", F.lit(1).cast("long").alias("weight"), F.lit(0).alias("side"), own("down").alias("i"), each("across").alias("j"))
    columns = members.join(grid, "grp").select("grp", "text", "weight", F.lit(1).alias("side"), own("across").alias("j"), each("down").alias("i")).select(*rows.columns)
    kind = texts.schema["grp"].dataType.simpleString()
    parts = _dealt(rows.unionByName(columns)).groupBy("grp", "i", "j").applyInArrow(_tile, f"grp {kind}, text string, part double")
    return parts.groupBy("grp", "text").agg(F.sum("part").alias("total"))


def _dealt(tiles: DataFrame) -> DataFrame:
    """Tiles are few bytes and much work, so their number of tasks is kept: by its size Spark would put them into a few."""
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "i", "j")


def weighed(texts: DataFrame) -> DataFrame:
    """The distinct texts (grp, text) of each group with how often they occur."""
    return texts.groupBy("grp", "text").agg(F.count("*").alias("weight"))


def average_likeness(texts: DataFrame) -> DataFrame:
    """grp, n and similarity: of normalised texts (grp, text) the mean likeness of all pairs in a group; 0 for a group of one. Null texts count as empty.

    Two blocks are compared once: one of their two tiles takes half of the rows of the lower block, the other one the rest. A tile sends one number.
    """
    distinct = weighed(texts.select("grp", F.coalesce("text", F.lit("")).alias("text")))
    self_pairs = F.col("weight") * F.when(F.length("text") > 0, 1.0).otherwise(0.0)
    by = distinct.groupBy("grp").agg(F.sum("weight").alias("n"), F.sum(self_pairs).alias("selves"), F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    own, half = F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"), F.pmod(F.hash("text"), F.lit(2)) == 0
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    b, others = F.col("b"), F.sequence(F.lit(0), F.col("blocks") - 1)
    above = F.transform(F.filter(others, lambda x: x > b), lambda x: place(F.when(half, b).otherwise(x), F.when(half, x).otherwise(b), 0))
    below = F.flatten(F.transform(F.filter(others, lambda x: x < b), lambda x: F.array(place(x, b, 1), place(b, x, 1))))
    places = F.explode(F.concat(F.array(place(b, b, 0), place(b, b, 1)), above, below))
    tiles = distinct.join(by.select("grp", "blocks"), "grp").withColumn("b", own).select("grp", "text", "weight", places.alias("p")).select("grp", "text", "weight", "p.*")
    tile, kind = _tile, texts.schema["grp"].dataType

    def summed(batch: pa.Table) -> pa.Table:
        parts = np.asarray(tile(batch).column("part"), float)
        weights = np.asarray(batch.filter(pa.compute.equal(batch.column("side"), 0)).column("weight"), float)
        twice = 1.0 if batch.column("i")[0] == batch.column("j")[0] else 2.0
        return pa.table({"grp": batch.column("grp").slice(0, 1), "part": pa.array([twice * float(parts @ weights)], pa.float64())})

    sums = _dealt(tiles).groupBy("grp", "i", "j").applyInArrow(summed, f"grp {kind.simpleString()}, part double").groupBy("grp").agg(F.sum("part").alias("part"))
    rows = by.join(sums, "grp").withColumn("both", F.col("part") - F.col("selves"))
    return rows.select("grp", "n", similarity_of("both", "n").alias("similarity"))


def class_steps(sizes: np.ndarray) -> np.ndarray:
    """How many sizes the class of each size has: one up to 15, then an eighth of a doubling."""
    return 1 << np.maximum(0, np.frexp(sizes.astype(float))[1].astype(np.int64) - 4)


def _cell(batch: pa.Table) -> pa.Table:
    """Of some texts of a group, by class of size: how many, in how many each bucket of bigrams stands (repeats counted), and the same of each pair of buckets, in parts."""
    buckets, texts, weights = 1 << 2 * UNIT_BITS, batch.column("text").to_pylist(), np.array(batch.column("weight"), float)
    mask, found = (1 << UNIT_BITS) - 1, {}
    for at in range(0, len(texts), CELL_STRIP):
        strip, w = texts[at : at + CELL_STRIP], weights[at : at + CELL_STRIP]
        code, owner = bigram_codes(strip)
        sizes = np.bincount(owner, minlength=len(strip))
        least = sizes // class_steps(sizes) * class_steps(sizes)
        bucket = ((code >> 16 & mask) << UNIT_BITS) | (code & mask)
        counts = np.bincount(owner * buckets + bucket, minlength=len(strip) * buckets).reshape(len(strip), buckets)
        for x in np.unique(least[least > 0]).tolist():
            y, v = counts[least == x].astype(np.float32), w[least == x]
            own = found.setdefault(x, [0.0, np.zeros(buckets), np.zeros((buckets, buckets))])
            weighted = y * np.sqrt(v)[:, None].astype(np.float32)
            own[0], own[1] = own[0] + v.sum(), own[1] + v @ y
            own[2] += weighted.T @ weighted
    rows = [(x, n, part, *(a[part::CELL_PARTS].ravel() for a in (one, two))) for x, (n, one, two) in found.items() for part in range(CELL_PARTS)]
    named = {"least": pa.int64(), "n": pa.float64(), "part": pa.int32(), "one": pa.list_(pa.float64()), "two": pa.list_(pa.float32())}
    columns = {c: pa.array([r[i].astype(np.float32) if c == "two" else r[i] for r in rows], t) for i, (c, t) in enumerate(named.items())}
    return pa.table({"grp": batch.column("grp").take(pa.array([0] * len(rows), pa.int64())), **columns})


def _paired_classes(batch: pa.Table) -> pa.Table:
    """Of one part of a group's counts, by pair of classes: least_a, least_b, top (the most in common), n_a, n_b, and the sums over pairs of texts of what they have in common and (in all parts together) of its square."""
    least = np.array(batch.column("least"))
    classes, place = np.unique(least, return_inverse=True)
    sums = []
    for c in ("n", "one", "two"):
        rows = np.array(batch.column(c).to_pylist() if c == "n" else batch.column(c).combine_chunks().flatten(), float).reshape(len(least), -1)
        sums.append(np.stack([rows[place == i].sum(0) for i in range(len(classes))]))
    n, one, two = sums[0][:, 0], sums[1] @ sums[1].T, sums[2] @ sums[2].T
    a, b = np.indices(one.shape).reshape(2, -1)
    grp = batch.column("grp").take(pa.array(np.zeros(len(a), np.int64)))
    greatest = classes + class_steps(classes) - 1
    return pa.table({"grp": grp, "least_a": classes[a], "least_b": classes[b], "top": np.minimum(greatest[a], greatest[b]), "n_a": n[a], "n_b": n[b], "one": one[a, b], "two": two[a, b]})


def greatest_likeness(distinct: DataFrame) -> DataFrame:
    """grp, n and most: of weighed texts (grp, text, weight; none null) a bound that the mean likeness of all pairs in a group is never above.

    Texts of s and t bigrams, c of them common, have the likeness c / (s + t - c), which bends upwards with c. So it lies under the parabola that touches it at the mean of c and meets
    it at the most that c can be, and the parabola's sum is known from the sums of c and of its square. Both are products of counts by bucket of bigrams, so they grow
    with the texts. Bigrams that share a bucket count as common, and a class of sizes counts as its least: both only lift the bound.
    """
    kind = distinct.schema["grp"].dataType.simpleString()
    filled = F.when(F.length("text") > 0, F.col("weight")).otherwise(0)
    sizes = distinct.groupBy("grp").agg(F.sum("weight").alias("n"), F.sum(filled).alias("selves"), F.ceil(F.count("*") / CELL_TEXTS).cast("int").alias("cells"))
    cells = distinct.join(sizes.select("grp", "cells"), "grp").select("grp", "text", "weight", F.pmod(F.xxhash64("text"), F.col("cells")).alias("cell"))
    cells = cells.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "cell")
    parts = cells.groupBy("grp", "cell").applyInArrow(lambda batch: _cell(batch), f"grp {kind}, least bigint, n double, part int, one array<double>, two array<float>")
    paired = parts.groupBy("grp", "part").applyInArrow(lambda batch: _paired_classes(batch), f"grp {kind}, least_a bigint, least_b bigint, top bigint, n_a double, n_b double, one double, two double")
    by = paired.groupBy("grp", "least_a", "least_b", "top").agg(*[F.max(c).alias(c) for c in ("n_a", "n_b")], *[F.sum(c).alias(c) for c in ("one", "two")])
    pairs, both = F.col("n_a") * F.col("n_b"), F.col("least_a") + F.col("least_b")
    by = by.select("grp", pairs.alias("pairs"), both.alias("both"), "top", (F.col("one") / pairs).alias("mean"), (F.col("two") * (1 + ROUNDING)).alias("two"))
    left = F.col("both") - F.col("mean")
    parabola = F.col("pairs") * F.col("mean") / left + F.col("both") / (left * left * (F.col("both") - F.col("top"))) * (F.col("two") - F.col("mean") * F.col("mean") * F.col("pairs"))
    straight = F.col("pairs") * F.col("top") / (F.col("both") - F.col("top"))
    bound = F.when(F.col("mean") < F.col("top"), F.least(parabola, straight)).otherwise(straight)
    rows = sizes.join(by.groupBy("grp").agg(F.sum(bound).alias("sum")), "grp", "left").withColumn("above", F.coalesce("sum", F.lit(0.0)) - F.col("selves"))
    return rows.select("grp", "n", similarity_of("above", "n").alias("most"))


def similarity_of(both: str, n: str) -> Column:
    """From the sum over ordered pairs."""
    n_ = F.col(n)
    return F.when(n_ > 1, F.greatest(F.lit(0.0), F.col(both)) / (n_ * (n_ - 1))).otherwise(0.0)
