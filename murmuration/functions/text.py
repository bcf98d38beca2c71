"""Text normalisation, contexts of matches and similarity as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

URL, MENTION, HASHTAG = r"https?://\S+", r"@\w+", r"#[^\s#]+"
#: White space as the rules mean it, for a character class.
SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LEAST_REPLY = 20
#: Stands beside a character beyond U+FFFF, for its second UTF-16 unit.
UNIT = "\uffff"
BEYOND = r"([\x{10000}-\x{10FFFF}])"


def utf16_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BEYOND, f"$1{UNIT}"))


def first_units(text: Column, n: int) -> Column:
    """The first `n` UTF-16 units, without a character that is cut in two."""
    return F.replace(F.substring(F.regexp_replace(F.substring(text, 1, n), BEYOND, f"{UNIT}$1"), 1, n), F.lit(UNIT), F.lit(""))


def last_units(text: Column, n: int) -> Column:
    return F.replace(F.right(F.regexp_replace(F.right(text, F.lit(n)), BEYOND, f"$1{UNIT}"), F.lit(n)), F.lit(UNIT), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms composed; Spark has no expression for it."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def contexts(text: Column, pattern: str, behind: int = 0, ahead: int = 0) -> Column:
    """All matches of `pattern` in order: array of (start, match, before, after); start in characters, before and after of so many UTF-16 units.

    Between two matches lies what `split` leaves, so starts are sums of lengths. The pattern must not match the empty text.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    empty = F.array().cast("array<struct<start:int,match:string>>")
    placed = F.aggregate(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("at"),
            F.concat(done["out"], F.array(F.struct((done["at"] + F.length(p["gap"])).alias("start"), p["match"].alias("match")))).alias("out"),
        ),
        lambda done: done["out"],
    )
    return F.transform(
        placed,
        lambda m: F.struct(
            m["start"].alias("start"), m["match"].alias("match"),
            last_units(F.substring(text, F.lit(1), m["start"]), behind).alias("before") if behind else F.lit("").alias("before"),
            first_units(F.substring(text, m["start"] + F.length(m["match"]) + 1, F.lit(ahead)), ahead).alias("after") if ahead else F.lit("").alias("after"),
        ),
    )


def fixed(value: Column, digits: int) -> Column:
    """`value` (under 10^9) with so many decimals, rounded by its exact binary value, halves away from zero.

    The value is split in two halves of its bits, whose products with the power of ten are exact, so that 0.075, which is stored a little lower, gives 0.07 and 0.125 gives 0.13.
    """
    power = float(10**digits)
    size = F.abs(value.cast("double"))
    bulk = size * 134217729.0
    high = bulk - (bulk - size)
    down = F.floor(size * power)
    over = (high * power - (down + 0.5)) + (size - high) * power
    whole = down + F.when(over >= 0, 1).otherwise(0)
    sign = F.when((value < 0) & (whole > 0), "-").otherwise("")
    if not digits:
        return F.concat(sign, whole.cast("string"))
    return F.concat(sign, F.floor(whole / power).cast("string"), F.lit("."), F.lpad((whole % int(power)).cast("string"), digits, "0"))


def once(value: Column, step: Callable[[Column], Column]) -> Column:
    """`step` of a value that it names several times: as the argument of a lambda the value is worked out once."""
    return F.get(F.transform(F.array(value), step), 0)


def normalize_for_similarity(text: Column, remove_hashtags: bool = False) -> Column:
    """Without links, mentions and optionally hashtags; white space (of all kinds) becomes one space; trimmed, lower case."""
    for pattern, sign in ((URL, "://"), (MENTION, "@"), *([(HASHTAG, "#")] if remove_hashtags else [])):
        own = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s#]", f"[^{SPACE}#]")
        text = once(text, lambda x: F.when(x.contains(sign), F.regexp_replace(x, own, "")).otherwise(x))  # noqa: B023 - called here
    return F.lower(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")))


def long_enough(clean: Column) -> Column:
    """Whether a text has LEAST_REPLY UTF-16 units."""
    return (F.length(clean) >= LEAST_REPLY) | (utf16_length(clean) >= LEAST_REPLY)


def normalize_reply(text: Column) -> Column:
    """Normalised; empty where fewer than LEAST_REPLY UTF-16 units are left."""
    return once(normalize_for_similarity(text), lambda x: F.when(~long_enough(x), "").otherwise(x))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character is its own."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
