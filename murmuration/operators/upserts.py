"""Merges of incoming rows into stored tables, as new tables: Spark writes the result as the next generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The row with the greatest `order` of each key; late, older rows never replace newer ones."""
    rest = [c for c in stored.columns if c not in keys]
    best = stored.unionByName(incoming.select(*stored.columns)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def _differs(columns: tuple[str, ...], sets: tuple[str, ...] = ()) -> Column:
    """Whether the structs `__was` and `__now` differ in any of the columns; sets are compared without order."""
    same = F.lit(True)
    for c in columns:
        order = (lambda x: F.array_sort(x)) if c in sets else (lambda x: x)
        same &= order(F.col(f"__was.{c}")).eqNullSafe(order(F.col(f"__now.{c}")))
    return ~same


def monotone(stored: DataFrame, incoming: DataFrame, key: str, order: str, plain: tuple[str, ...], flags: tuple[str, ...], sets: tuple[str, ...], kept: tuple[str, ...], most: tuple[str, ...], last: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows with a batch merged in, and `changed` (a row is new or differs in anything but `last`).

    The batch's rows of one key are merged first, later ones (by `order`) last. `plain` columns and `last` are the newest row's, counts that fall among them; `flags` never turn false again; `sets` only grow,
    new members first; `kept` columns keep their value where the newer one is null; `most` keep the greater value. Keys of either side stay; stored rows that the batch doesn't have don't change.
    """
    columns = (*plain, *flags, *sets, *kept, *most, *last)
    newest = [F.max_by(c, order).alias(c) for c in (*plain, *last)]
    held = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in kept]
    grown = [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.array()).alias("v"))), asc=False), lambda x: x["v"]))).alias(c) for c in sets]  # a key's rows in a batch are few
    batch = incoming.groupBy(key).agg(*newest, *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in flags], *grown, *held, *[F.max(c).alias(c) for c in most])
    rows = stored.select(key, F.struct(*columns).alias("__was")).join(batch.select(key, F.struct(*columns).alias("__in")), key, "full_outer")
    was, new = (lambda c: F.col(f"__was.{c}")), (lambda c: F.col(f"__in.{c}"))
    merged = {c: new(c) for c in (*plain, *last)} | {c: new(c) | F.coalesce(was(c), F.lit(False)) for c in flags} | {c: F.array_distinct(F.concat(new(c), F.coalesce(was(c), F.array()))) for c in sets}
    merged |= {c: F.coalesce(new(c), was(c)) for c in kept} | {c: F.greatest(new(c), was(c)) for c in most}
    rows = rows.withColumn("__now", F.when(F.col("__in").isNull(), F.col("__was")).otherwise(F.struct(*[merged[c].alias(c) for c in columns])))
    return rows.select(key, "__now.*", (F.col("__was").isNull() | _differs(tuple(c for c in columns if c not in last), sets)).alias("changed"))


def replaced(stored: DataFrame, incoming: DataFrame, key: str, order: str, first: tuple[str, ...], watched: tuple[str, ...]) -> DataFrame:
    """Stored rows with a batch put in their place, and `changed`: whether a row is new or differs in a `watched` column. Of several rows of a key the last by `order` counts; `first` columns keep what they had."""
    columns = [c for c in stored.columns if c != key]
    batch = incoming.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__in"))
    rows = stored.select(key, F.struct(*columns).alias("__was")).join(batch, key, "full_outer")
    now = F.struct(*[(F.coalesce(F.col(f"__was.{c}"), F.col(f"__in.{c}")) if c in first else F.when(F.col("__in").isNull(), F.col(f"__was.{c}")).otherwise(F.col(f"__in.{c}"))).alias(c) for c in columns])
    rows = rows.withColumn("__now", now)
    return rows.select(key, "__now.*", (F.col("__was").isNull() | _differs(watched)).alias("changed"))


def recorded(latest: DataFrame, incoming: DataFrame, keys: tuple[str, ...], watched: tuple[str, ...], at: str) -> DataFrame:
    """Incoming rows with what becomes of each: `noop` (the latest row is the same in all `watched` columns), `history` (it is new history) and `newest` (it becomes the latest row, as that isn't newer).

    Incoming keys are distinct.
    """
    rows = incoming.withColumn("__now", F.struct(*watched)).join(latest.select(*keys, F.struct(*watched).alias("__was"), F.col(at).alias("__at")), list(keys), "left")
    noop = F.col("__was").isNotNull() & ~_differs(watched)
    return rows.select(*incoming.columns, noop.alias("noop"), (~noop).alias("history"), (~noop & (F.col("__at").isNull() | (F.col("__at") <= F.col(at)))).alias("newest"))


def by_group(stored: DataFrame, incoming: DataFrame, key: str, groups: dict[str, tuple[str, ...]], order: str) -> DataFrame:
    """Rows of either side by key, where each group of columns has a watermark of its own: a row that is newer in one group and older in another changes the first alone.

    `groups`: the columns by the name of their watermark. Incoming rows are taken in the order of their column `order`; one as new as what is there
    replaces it. A row without a watermark replaces nothing but a group that has none either. One aggregation does it all, so a key's rows are merged before they are sent.
    """
    columns = [key, *[c for at, own in groups.items() for c in (*own, at)]]
    both = stored.select(*columns, F.lit(None).cast(incoming.schema[order].dataType).alias("__order")).unionByName(incoming.select(*columns, F.col(order).alias("__order")))
    best = both.groupBy(key).agg(*[F.max_by(F.struct(*own, at), F.struct(at, "__order")).alias(f"__{at}") for at, own in groups.items()])  # nulls are the least
    return best.select(key, *[f"__{at}.{c}" for at, own in groups.items() for c in (*own, at)])


def first_only(stored: DataFrame, claims: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Claims on keys that nobody holds: the first one of each key."""
    free = claims.join(stored.select(*keys), list(keys), "left_anti")
    return free.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def retained(rows: DataFrame, at: str, cutoff: str) -> DataFrame:
    """Rows at or after the cutoff (a date)."""
    return rows.where(F.col(at) >= F.lit(cutoff).cast("timestamp_ntz"))
