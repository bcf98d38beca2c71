"""A stored table kept up by a stream: late, older rows never replace newer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.upserts import guarded
from .generations import rewrite


def keep_newest(stream: DataFrame, folder: str, keys: tuple[str, ...], order: tuple[str, ...]) -> DataStreamWriter:
    """A writer that merges each batch into the buckets that it touches (see `generations`); the row with the greatest `order` of each key stays."""

    def merge(batch: DataFrame, number: int) -> None:
        rewrite(batch, number, folder, keys, batch.schema, lambda stored, new: guarded(stored, new, keys, order))

    return stream.writeStream.outputMode("append").foreachBatch(merge)
