"""From raw documents to tokens: quality, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; `run` writes
each result as Parquet and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import bpe, jaccard_join, line_dedup, mixing, quality
from murmuration.llm.common import documents, labels, spool

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the cut or above stay."""
    model = quality.train(docs, labels(spark, sf_dir).where(~quality.held_out()))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or resemble an earlier line go, and texts of which nothing stays."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the least doc_id's (null ids last), of rows that share it the one with the least hash of its text."""
    rows = spool(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = spool(jaccard_join.near_duplicates(rows, id_col="row"), "near")
    grouped = found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    # Components of one row stay without a look at their rows.
    several = grouped.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    keyed = grouped.join(several, "component_id").join(rows.select("row", order.alias("order")), "row")
    keep = keyed.groupBy("component_id").agg(F.min("order").alias("first")).select("component_id", F.col("first.row").alias("kept"))
    dropped = keyed.join(keep, "component_id").where("row <> kept").select("row")
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    mixed = mixing.mix(docs.select(*COLUMNS)).withColumn("copies", mixing.copies())
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the learned scores and the hash-random mix; a plain version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
