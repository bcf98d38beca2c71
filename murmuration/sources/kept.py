"""Tables that several parts of a query read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def shared_folder(df: DataFrame) -> str:
    """The folder named by spark.checkpoint.dir; in local mode one of our own where it is unset."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shared-"))
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """`df` as a written table: it is computed once, and no executor's loss undoes it."""
    path = f"{shared_folder(df)}/kept-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
