"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in the order of their
keys, cut into key ranges; token counts are summed by range, the sums are accumulated over the
ranges, and only the range that holds a source's cut is sorted. The cut is exact, and is known as
one key for each source, so documents are taken or left without moving them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, small, spool, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Of all tokens, what the mix shares out; of its own tokens, what a source gives at most.
BUDGET, MOST_EPOCHS = 1.5, 2
#: Key ranges of a source. Each holds an equal share of the source, as keys are uniform.
RANGES = 1 << 12
#: Keys that a source's rows are dealt over where sources are too many to broadcast.
SALTS = 16


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds weight and target to (source, source_size), one row for each source.

    A source's target is min(epochs * size, level * weight), with the level at which all targets
    are the budget: what remains above a full source's limit goes to the others by weight. Sources
    fill in the order of limit / weight, so running sums in that order give the level.
    """
    n = len(weights)
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("__fill", F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    whole = Window.partitionBy()
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("__limit", F.col("source_size") * float(epochs))
        .withColumn("__fill", F.col("__limit") / F.col("weight"))
        .withColumn("__budget", F.sum("source_size").over(whole) * budget)
        .withColumn("__level", (F.col("__budget") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        # the first source in the order that the level does not fill; from there on all share that level
        .withColumn("__place", F.when(F.col("__level") < F.col("__fill"), F.row_number().over(by_fill)))
        .withColumn("__level", F.min_by("__level", "__place").over(whole))
    )
    target = F.when(F.col("__level").isNull(), F.col("__limit")).otherwise(F.least(F.col("__limit"), F.col("__level") * F.col("weight")))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, size: Column | None = None, seed: int = 17, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = MOST_EPOCHS) -> DataFrame:
    """All columns of `docs` and size, source_size, target, taken (tokens that the mix takes of the row, repeats counted).

    Columns of these names that `docs` has already are replaced. Null sources are one source, last
    in order; rows of size 0 take 0. Rows with the same key (repeated rows) share what falls to the
    key. The same input and seed give the same mix, however it is partitioned.
    """
    ends = ("size", "source_size", "target", "taken")
    text = next((c for c in docs.columns if c == "text"), None)
    own = docs.drop(*ends[1:]).withColumn("size", word_count() if size is None else size).withColumns(
        {"__source": F.col(source_col), "__key": F.xxhash64(F.lit(seed), *[F.col(c) for c in ("doc_id", text) if c and c in docs.columns])}
    )
    reach = F.shiftrightunsigned(F.col("__key"), 64 - (RANGES.bit_length() - 1)).alias("range")
    sums = spool(own.select(F.col("__source").alias("source"), reach, "size").groupBy("source", "range").agg(F.sum("size").alias("tokens")), "ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, budget, epochs)
    # Whole epochs, and the tokens to take once more.
    targets = spool(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "targets",
    )
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        sums.withColumn("before", F.coalesce(F.sum("tokens").over(along), F.lit(0)))
        .join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("before <= rest AND rest < before + tokens")
        .select("source", "range", "before", "rest")
    )
    at = small(spool(at.select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "rest"), "ranges-cut"))
    cut = (
        own.select(F.col("__source").alias("source"), F.col("__key").alias("key"), reach, "size")
        .join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("tokens"))
        .withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy(_ordered("key")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("before <= rest AND rest < before + tokens")
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("part"), F.col("tokens").alias("of"))
    )
    decided = targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("__s"), "source_size", "target", "epochs", "cut_key", "part", "of")
    key, at_key = _ordered("__key"), _ordered("cut_key")
    once_more = (
        F.when(F.col("cut_key").isNull(), 0).when(key < at_key, F.col("size")).when(key == at_key, F.floor(F.col("size") * F.col("part") / F.col("of"))).otherwise(0)
    )
    return (
        _with_source(own, spool(decided, "decided"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + once_more).cast("long"))
        .select(*[c for c in docs.columns if c not in ends], *ends)
    )


def _with_source(own: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows with what is decided for their source, one row for each: broadcast where the sources are few enough, else joined with each source's rows dealt over several keys."""
    same = F.col("__source").eqNullSafe(F.col("__s"))
    if decided.count() <= BROADCAST_ROWS:
        return own.join(F.broadcast(decided), same, "left")
    salted = decided.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.withColumn("__salted", F.pmod("__key", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__salted") == F.col("__salt")), "left")


def _ordered(col: str) -> Column:
    """Signed keys in the order of their unsigned ranges."""
    return F.col(col).bitwiseXOR(F.lit(-(1 << 63)))


def copies() -> Column:
    """How often a document's row is in the mix: repeats of whole texts, a part of half the text or more counting as one."""
    return F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0).cast("int")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")
