"""Start one streaming query with the settings all queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pulsetally.config import StreamSettings
from pulsetally.sources.folders import stream_folder

WIDTH = "spark.sql.shuffle.partitions"


def start_query(
    frame: DataFrame, writer: DataStreamWriter, settings: StreamSettings, name: str
) -> StreamingQuery:
    """Name the query, give it its checkpoint, trigger and state width, and start it."""
    named = (
        writer.queryName(name)
        .option("checkpointLocation", settings.checkpoint(name))
        .trigger(**settings.trigger_options())
    )
    if settings.state_partitions is None:
        return named.start()
    # A query copies the session's settings when it starts.
    conf = frame.sparkSession.conf
    before = conf.get(WIDTH)
    conf.set(WIDTH, str(settings.state_partitions))
    try:
        return named.start()
    finally:
        conf.set(WIDTH, before)


def start_file_query(
    rows: DataFrame,
    path: str,
    settings: StreamSettings,
    name: str,
    partitions: tuple[str, ...] = (),
) -> StreamingQuery:
    """Append to a table's folder for this checkpoint; its commit log makes it exactly-once."""
    folder = stream_folder(rows.sparkSession, path, settings.checkpoint(name))
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", folder)
    if partitions:
        writer = writer.partitionBy(*partitions)
    return start_query(rows, writer, settings, name)
