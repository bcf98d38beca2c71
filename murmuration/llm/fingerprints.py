"""Document fingerprints of closed syncmers.

A text is a sequence of tokens (words, long ones in pieces). Of its k-mers those are anchors whose
least s-mer, by hash, is the first or the last one in them. Whether a k-mer is an anchor depends on
the k-mer alone, so an edit elsewhere never changes which are. All anchors with their positions are the
document's fingerprint. Two fingerprints agree in an anchor that stands in both at the same distance
from the anchor before or behind it, and their likeness is the share of such anchors in all of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, spool, text_or_empty

#: Tokens of a k-mer (K) and of an s-mer in it (S): K - S + 1 = 4 s-mers, of which the edges are two.
K, S = 5, 2
#: Longest token in code points; longer words are cut, so texts without white space have many tokens too.
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Cells that ids are counted in, and rows of a chunk of neighbouring ids.
CELLS, CHUNK_ROWS = 1 << 14, 1_000


def with_anchors(df: DataFrame, text: str, name: str, positions: bool = False) -> DataFrame:
    """Adds `name`: the anchors' hashes in order, or with `positions` structs of hash and token position.

    A text with fewer than K tokens but at least one code point has one anchor, itself.
    Each step is a column of its own, so that no step is evaluated for every element of the next.
    """
    t, w, s, z = f"__{name}_t", f"__{name}_w", f"__{name}_s", f"__{name}_z"
    df = df.withColumn(t, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(w, F.transform(t, lambda x: F.xxhash64(x))).drop(t)
    df = df.withColumn(s, F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))).drop(w)
    tail = lambda i: F.slice(s, i, 1 << 30)
    df = df.withColumn(z, F.arrays_zip(F.col(s).alias("a"), tail(2).alias("b"), tail(3).alias("c"), tail(4).alias("d"))).drop(s)
    # The zip and the pairs above run to the longest array; past its end the edges are null.
    closed = lambda x: x["d"].isNotNull() & (F.least(x["a"], x["d"]) <= F.least(x["b"], x["c"]))
    value = lambda x: F.hash(x["a"], x["b"], x["c"], x["d"]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    alone = F.hash(text).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    if positions:
        df = df.withColumn(z, F.transform(z, lambda x, i: F.struct(value(x).alias("hash"), i.alias("position"), closed(x).alias("closed"))))
        found = F.transform(F.filter(z, lambda x: x["closed"]), lambda x: F.struct(x["hash"], x["position"]))
        short = F.array(F.struct(alone.alias("hash"), F.lit(0).alias("position")))
    else:
        found = F.transform(F.filter(z, closed), value)
        short = F.array(alone)
    df = df.withColumn(name, found).drop(z)
    return df.withColumn(name, F.when((F.size(name) == 0) & (F.length(text) > 0), short).otherwise(F.col(name)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: all anchors of the text in order, as structs of hash and token position."""
    return with_anchors(df, text, name, positions=True)


def spelled(fingerprint: str) -> Column:
    """hash (8 hexadecimal digits):position of each anchor, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 8, "0"), F.lit(":"), x["position"].cast("string"))), ",")


def _placed(fingerprint: str) -> tuple[Column, Column]:
    """Longs for each anchor: its hash, then 32 bits of the anchor before (or the text's start) and the distance to it; the same of the anchor behind, which the last one lacks."""
    own = F.col(fingerprint)
    most = F.greatest(F.size(own) - 1, F.lit(0))
    head, tail = F.slice(own, F.lit(1), most), F.slice(own, 2, 1 << 30)
    key = lambda x, other, gap: F.shiftleft(x["hash"], 32).bitwiseOR(F.hash(other, gap).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    start = F.array(F.struct(F.lit(-1).cast("long").alias("hash"), F.lit(0).alias("position")))
    before = F.zip_with(F.slice(own, 1, 1 << 30), F.slice(F.concat(start, own), F.lit(1), F.size(own)), lambda x, y: key(x, y["hash"], x["position"] - y["position"]))
    behind = F.zip_with(head, tail, lambda x, y: key(x, y["hash"], y["position"] - x["position"]))
    return before, behind


def likeness(a: str, b: str) -> Column:
    """Of the distinct anchors of both fingerprints, the share in which they agree. 1 for two empty texts, 0 for one.

    They agree in an anchor that stands in both at the same distance from the same anchor before it (the
    first one: from the text's start) or from the same one behind it, wherever that is in the texts.
    """
    (before_a, behind_a), (before_b, behind_b) = _placed(a), _placed(b)
    agreed = F.transform(F.concat(F.array_intersect(before_a, before_b), F.array_intersect(behind_a, behind_b)), lambda x: F.shiftrightunsigned(x, 32))
    union = F.size(F.array_union(F.col(a)["hash"], F.col(b)["hash"]))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_distinct(agreed)) / union).cast("double")


def with_next(df: DataFrame, id_col: str, text: str, carried: dict) -> DataFrame:
    """Adds the columns of `carried` (name: function of df that adds it), then next_<c> of those and of the text:
    the value in the next row, descending by id (after the last, the first).

    Ids are counted in cells of equal width, cells are gathered into chunks of about CHUNK_ROWS
    rows, and each chunk is sorted by itself; the first row of each chunk is sent to the chunk
    before as well. Rows that share an id follow each other by a hash of the text; null ids come last.
    """
    values = [text, *carried]
    limits = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count("*").alias("n")).first()
    lo, width, n = limits["lo"] or 0, (limits["hi"] or 0) - (limits["lo"] or 0) + 1, limits["n"]
    cell = F.coalesce(F.floor((F.col(id_col) - lo) * float(CELLS) / float(width)), F.lit(-1)).cast("int")
    per_chunk = max(CHUNK_ROWS, n // CELLS)
    tie = F.xxhash64(text)
    keyed = df.select("*", cell.alias("__cell"))
    counts = keyed.groupBy("__cell").agg(F.count("*").alias("__n"), F.max(F.struct(F.col(id_col).alias("i"), tie.alias("t"))).alias("__head"))
    # From here on tables of CELLS + 1 rows at most.
    down = Window.orderBy(F.col("__cell").desc())
    cells = counts.withColumn("__chunk", F.floor(F.coalesce(F.sum("__n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / per_chunk).cast("int"))
    cells = spool(cells, "cells")
    heads = cells.groupBy("__chunk").agg(F.max_by("__head", "__cell").alias("__head"))
    along, whole = Window.orderBy("__chunk"), Window.partitionBy()
    before = heads.select("__head", F.coalesce(F.lag("__chunk").over(along), F.max("__chunk").over(whole)).alias("__chunk"))
    placed = keyed.join(F.broadcast(cells.select("__cell", "__chunk")), "__cell").drop("__cell").withColumn("__ghost", F.lit(0))
    # A head that is repeated whole may come as often; any of them is the next row.
    ghosts = df.join(
        F.broadcast(before), F.col(id_col).eqNullSafe(F.col("__head.i")) & (tie == F.col("__head.t"))
    ).select(*df.columns, "__chunk", F.lit(1).alias("__ghost"))
    both = placed.unionByName(ghosts)
    for add in carried.values():
        both = add(both)
    order = Window.partitionBy("__chunk").orderBy("__ghost", F.col(id_col).desc_nulls_last(), tie.desc())
    led = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in values})
    return led.where("__ghost = 0").drop("__ghost", "__chunk")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint (array of hash and position of all anchors): one row for each row of `docs`; a null text counts as empty and has no anchors."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_fingerprint(own, "text", "fingerprint")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and of edited texts: the last third replaced by the beginning of the next document."""
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    rows = with_next(docs, "doc_id", "text", {})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    # Anchors, which can take more room than the texts, are made after the last exchange.
    for text, name in (("text", "fingerprint"), ("next_text", "next_fingerprint"), ("edited", "edited_fp")):
        rows = with_fingerprint(rows, text, name)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled("fingerprint").alias("fingerprint"),
        spelled("edited_fp").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fp").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
