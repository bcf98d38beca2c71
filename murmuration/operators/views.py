"""Read views, for all labels, accounts or findings at once, and pages by key."""

from __future__ import annotations

import base64
import binascii
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.scores import severity_rank

# Fixed values of the views: bounds of lists, and the ranks of quality (states without a rank are 0).
HISTORY_ROWS, HISTORY_ENTRIES, RELATIONS, OCCURRENCES = 2000, 20, 100, 10
QUALITY = {"degraded": 3, "watch": 2, "unknown": 1, "stable": 0}


class Key(NamedTuple):
    """A column to sort by, and how; nulls come last either way."""

    name: str
    desc: bool = False

    def order(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.desc else F.col(self.name).asc_nulls_last()


def behind(keys: tuple[Key, ...], values: tuple) -> Column:
    """Rows that come behind the one with these values of the keys."""
    out, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values, strict=True):
        col = F.col(key.name)
        if value is not None:  # behind a null there are only further nulls
            out = out | (same & (col.isNull() | ((col < F.lit(value)) if key.desc else (col > F.lit(value)))))
        same = same & col.eqNullSafe(F.lit(value))
    return out


def encoded(values: tuple, filters: str) -> str:
    """A cursor: the values of the last row as text (the empty text for null) and the filters that it holds for, as base64url without padding."""
    told = json.dumps({"sortValues": ["" if v is None else str(v) for v in values], "filterHash": filters}, ensure_ascii=False, separators=(",", ":"))
    return base64.urlsafe_b64encode(told.encode()).decode().rstrip("=")


def decoded(cursor: str | None, filters: str) -> list[str] | None:
    """The values of a cursor; None where there is none, it can't be read, or it is of other filters: the first page follows."""
    try:
        told = json.loads(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)))
    except (binascii.Error, ValueError):
        return None
    if not isinstance(told, dict) or told.get("filterHash") != filters or not isinstance(told.get("sortValues"), list):
        return None
    return told["sortValues"] if all(isinstance(v, str) for v in told["sortValues"]) else None


def page(rows: DataFrame, keys: tuple[Key, ...], limit: int, cursor: str | None = None, filters: str = "") -> tuple[list[Row], str | None]:
    """The rows of one page, `limit` at most, and the next page's cursor (None behind the last). The keys tell all rows apart."""
    values = decoded(cursor, filters)
    if values is not None and len(values) == len(keys):
        kinds = [rows.schema[k.name].dataType for k in keys]
        rows = rows.where(behind(keys, tuple(None if v == "" and t.simpleString() != "string" else v if t.simpleString() == "string" else int(v) for v, t in zip(values, kinds))))
    found = rows.orderBy(*[k.order() for k in keys]).limit(limit + 1).collect()
    more = len(found) > limit
    return found[:limit], encoded(tuple(found[limit - 1][k.name] for k in keys), filters) if more else None


def filtered(rows: DataFrame, status: tuple[str, ...] | None = None, severity: tuple[str, ...] = (), **equal: str | None) -> tuple[DataFrame, str]:
    """Findings under the filters given (open ones by default), with severity_rank, and the filters' own text, in which their order doesn't tell."""
    status = ("active", "recurring") if status is None else status
    out = rows.where(F.col("status").isin(*status))
    out = out.where(F.col("severity").isin(*severity)) if severity else out
    for name, value in equal.items():
        out = out.where(F.col(name) == value) if value else out
    told = {"status": sorted(status), "severity": sorted(severity)} | {k: v or None for k, v in sorted(equal.items())}
    return out.withColumn("severity_rank", severity_rank("severity")), json.dumps(told, separators=(",", ":"))


FINDING_KEYS = (Key("severity_rank", True), Key("last_detected", True), Key("id", True))


def label_list(summary: DataFrame) -> DataFrame:
    """Label summaries (label_key, quality, active_findings, prevalence, ...) with their `place`: the worst quality first, then those with findings, then by prevalence, then by key."""
    rank = F.lit(0)
    for name, value in QUALITY.items():
        rank = F.when(F.col("quality") == name, value).otherwise(rank)
    order = (rank.desc(), (F.col("active_findings") > 0).desc(), F.col("prevalence").desc(), F.col("label_key"))
    return summary.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row for each label


def label_heads(snapshots: DataFrame) -> DataFrame:
    """By label the newest complete snapshot (id, at, evaluated, true_count, prevalence; nulls without one), and whether a newer one has failed."""
    newest = F.struct("at", "id")
    by = snapshots.groupBy("label_key").agg(F.max_by("completeness", newest).alias("last"), F.max_by(F.struct("id", "at", "evaluated", "true_count"), F.when(F.col("completeness") == "complete", newest)).alias("s"))
    share = F.when(F.col("s.evaluated") == 0, 0.0).otherwise(F.col("s.true_count") / F.col("s.evaluated"))
    return by.select("label_key", "s.id", "s.at", "s.evaluated", "s.true_count", share.alias("prevalence"), (F.col("last") != "complete").alias("failed"))


def label_trends(snapshots: DataFrame, now_ms: int, days: int) -> DataFrame:
    """By label and UTC day, the last complete snapshot of the day, of the days from `days` before now on."""
    day = F.floor(F.col("at") / 86_400_000)
    rows = snapshots.where((F.col("completeness") == "complete") & (F.col("at") <= now_ms) & (day * 86_400_000 >= now_ms - days * 86_400_000))
    by = rows.groupBy("label_key", day.alias("day")).agg(F.max_by(F.struct("evaluated", "true_count"), F.struct("at", "id")).alias("s"))
    return by.select("label_key", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), "s.evaluated", "s.true_count", F.when(F.col("s.evaluated") == 0, 0.0).otherwise(F.col("s.true_count") / F.col("s.evaluated")).alias("prevalence"))


def label_histories(history: DataFrame, most_rows: int = HISTORY_ROWS, entries: int = HISTORY_ENTRIES) -> DataFrame:
    """The rows that an account's page shows below each label: of the account's newest rows, by label, those behind the newest one, with their place from 1."""
    newest = Window.partitionBy("account_id").orderBy(F.desc("labeled_at"), F.desc("id"))
    seen = history.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most_rows)
    place = F.row_number().over(Window.partitionBy("account_id", "label_key").orderBy("__n")) - 1
    return seen.withColumn("place", place).where(F.col("place").between(1, entries)).drop("__n")


def relations(edges: DataFrame, owner: str, other: str, seen: str, most: int = RELATIONS) -> DataFrame:
    """owner, total and the newest others by `seen`, ties by other, as an array of at most so many."""
    totals = edges.groupBy(owner).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.col(seen).desc(), other))
    top = edges.withColumn("__n", rank).where(F.col("__n") <= most).groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", other))), lambda x: x[other]).alias("others"))  # `most` each
    return totals.join(top, owner).select(F.col(owner).alias("owner"), "total", "others")


def finding_details(findings: DataFrame, occurrences: DataFrame, most: int = OCCURRENCES) -> DataFrame:
    """Findings (id, ...) with their newest occurrences (id, finding_id, observed_at, ...), one row each, place from 1; a finding without any has one row with nulls."""
    rank = F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("observed_at"), F.desc("id")))
    top = occurrences.withColumn("place", rank).where(F.col("place") <= most).withColumnRenamed("id", "occurrence_id")
    return findings.join(top, F.col("id") == F.col("finding_id"), "left").drop("finding_id")


def dashboard(accounts: DataFrame, posts: DataFrame, active: DataFrame) -> DataFrame:
    """One row: accounts, posts, accounts with an active label (of `active`: account_id, active_label_count), and when an account was last crawled (crawled_at)."""
    parts = (accounts.agg(F.count("*").alias("accounts"), F.max("crawled_at").alias("last_crawled_at")), posts.agg(F.count("*").alias("posts")), active.agg(F.count_if(F.col("active_label_count") > 0).alias("labeled_accounts")))
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def top_labels(summary: DataFrame, most: int) -> DataFrame:
    """The labels with the most true rows; of equals in the order of their keys."""
    return summary.orderBy(F.desc("true_count"), "label_key").limit(most)


def redacted(text: Column, most: int = 200) -> Column:
    """The first line, cut after so many characters with an ellipsis."""
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def search_document(screen_name: Column, display_name: Column) -> Column:
    return F.lower(F.concat(screen_name, F.lit(" "), display_name))
