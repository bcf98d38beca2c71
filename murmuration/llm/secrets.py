"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text. How many repositories and owners have the same candidate
tells copied examples from live-looking credentials of few owners. An owner is a distinct text of a
repository, so exact copies of one document there are one owner. Bare tokens count as secrets only when they aren't widely
copied, and candidates that a pattern names stay and are classified by the same bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spool, text_or_empty

# The patterns of the three named kinds and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more from AKIA on; shorter runs hold no match
HEX = r"[0-9a-f]{16,}"  # runs of 16 or more; runs are whole as matches are greedy
LEAST_ASSIGNED = 12
#: Bare tokens: 20 characters or more with letters of both cases and digits, as issued keys have.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{20,}+"
BARE_GUARD = r"[A-Za-z0-9+/_=-]{20}"
KINDS = ("assign", "access", "hex", "bare")
#: Repositories or owners from which on a candidate is a copied example.
EXAMPLE_OWNERS = 3

#: A candidate by its place; of its value only the sha256 goes on, so that no written table lists the secrets.
SPAN = "array<struct<start:int,kind:int,end:int,value_hash:string>>"


def _spans(text: str, pattern: str, kind: int, guard: str | None = None, group: int = 0, least: int = 0) -> Column:
    """Matches of `pattern` in order, with code point offsets: what lies between matches, and the matches, have lengths that add up."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    empty = F.array().cast(SPAN)
    found = F.aggregate(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("at"),
            F.when(
                F.length(p["value"]) >= least,
                F.concat(
                    done["out"],
                    F.array(
                        F.struct(
                            (done["at"] + F.length(p["gap"])).alias("start"),
                            F.lit(kind).alias("kind"),
                            (done["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("end"),
                            F.sha2(p["value"], 256).alias("value_hash"),
                        )
                    ),
                ),
            ).otherwise(done["out"]).alias("out"),
        ),
        lambda done: done["out"],
    )
    return F.when(F.col(text).rlike(guard or pattern), found).otherwise(empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "source") -> DataFrame:
    """doc_id, repo, row (sha256 of id, repository and text, for joins), content (of the text in lower case, to count owners by), base and bare spans: one row for each row of `docs`."""
    own = docs.select(
        F.col(id_col).alias("doc_id"), (F.col(repo_col) if repo_col in docs.columns else F.lit(None)).cast("string").alias("repo"), text_or_empty(text_col).alias("text")
    )
    return own.select(
        "doc_id",
        "repo",
        F.sha2(F.concat(F.to_json(F.struct("doc_id", "repo")), F.sha2("text", 256)), 256).alias("row"),
        F.sha2(F.lower("text"), 256).alias("content"),
        _spans("text", ASSIGN, 0, r"(?i:passw|secret|token|api_?key)", 2, LEAST_ASSIGNED).alias("assign"),
        _spans("text", ACCESS, 1).alias("access"),
        _spans("text", HEX, 2).alias("hex"),
        _spans("text", BARE, 3, BARE_GUARD).alias("bare"),
    ).withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repositories, owners, occurrences: of each candidate value.

    A repository is a source and an owner a distinct text (but for case) in one: copies of a text
    within a source are one owner, a copy in another source is another.
    """
    values = found.select("content", "repo", F.explode(F.concat("base", "bare")).alias("span"))
    each = values.groupBy(F.col("span.value_hash").alias("value_hash"), "repo", "content").agg(F.count("*").alias("n"))
    by_repo = each.groupBy("value_hash", "repo").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    return by_repo.groupBy("value_hash").agg(F.count("*").alias("repositories"), F.sum("owners").alias("owners"), F.sum("n").alias("occurrences"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "source") -> DataFrame:
    """doc_id, repo and spans: array of (start, kind, end, value_hash, owners, repositories, live); base and n_assign, n_access, n_hex besides.

    Offsets are in code points, the end is exclusive, and texts are scanned whole, however long; a value is told by its sha256 alone. A null or empty text has no spans. Rows with the
    same text have the same spans each and count as one owner in each repository. An empty table gives an
    empty result; columns but the three named are not looked at. Base spans always stay; a bare
    token is a span when it touches no base span and is live: under EXAMPLE_OWNERS owners and repositories.
    """
    found = spool(candidates(docs, id_col, text_col, repo_col), "secrets")
    some = found.where("size(base) + size(bare) > 0")
    spans = some.select("row", "base", F.explode(F.concat("base", "bare")).alias("span")).dropDuplicates(["row", "span"])
    rated = spans.withColumn("value_hash", F.col("span.value_hash")).join(ownership(some), "value_hash")
    free = ~F.exists("base", lambda b: (b["start"] < F.col("span.end")) & (F.col("span.start") < b["end"]))
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_OWNERS)
    kept = rated.where((F.col("span.kind") < 3) | (free & live)).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("span.start", "span.kind", "span.end", "span.value_hash", "owners", "repositories", live.alias("live")))).alias("spans")
    )
    # one text's own candidates are all that a group holds
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    spanned = found.select("doc_id", "repo", "row", "base", *counts).join(kept, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value_hash:string,owners:bigint,repositories:bigint,live:boolean>>")
    return spanned.select("doc_id", "repo", "base", *[f"n_{k}" for k in KINDS[:3]], F.coalesce("spans", none).alias("spans"))


def spelled(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(spelled("base"), 256).alias("base_sha256"),
        spelled("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
