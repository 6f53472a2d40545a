"""Sinks: append-only NDJSON, server-sent frames, and a backlog that goes on live without gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from filament.functions.text import sse_frame


def append_ndjson(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends rows as NDJSON files; UTF-8 as it is, null fields absent, each batch exactly once."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def frames(rows: DataFrame) -> DataFrame:
    """One server-sent frame per row."""
    return rows.select(sse_frame(F.to_json(F.struct("*"))).alias("frame"))


def follow(spark: SparkSession, path: str, schema, handle, checkpoint: str, **trigger) -> StreamingQuery:
    """Hands a log's backlog and then its new rows to ``handle`` (a DataFrame a batch), none twice.

    The file source lists what is there first and remembers it, so backlog and live rows are one
    stream: what is written between the two is in the next batch.
    """
    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(lambda df, _: handle(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_slice(rows: DataFrame, path: str) -> None:
    """A reference slice, replaced as a whole; writing it again changes nothing."""
    rows.write.mode("overwrite").json(path)
