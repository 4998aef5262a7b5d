"""Start the streaming queries over one source and watch over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pulsetally.config import StreamSettings
from pulsetally.operators.decode import parse_payload
from pulsetally.operators.metrics import Uniques
from pulsetally.operators.validate import check_events, record_defaults, valid_events
from pulsetally.plans.landing import stream_landing
from pulsetally.schema import TABLE_SCHEMAS
from pulsetally.sinks import lake
from pulsetally.sinks import metrics as metric_sinks
from pulsetally.sources.folders import run_of
from pulsetally.streaming import metrics

# (table name, its schema, run of the checkpoint) -> writer of its micro-batches.
WriterFor = Callable[[str, StructType, str], metric_sinks.BatchWriter]


def start_jobs(
    events: DataFrame,
    settings: StreamSettings,
    lake_path: str | None = None,
    metrics_path: str | None = None,
    writer_for: WriterFor | None = None,
    uniques: Uniques = "approx",
    on_error: metric_sinks.OnError = "raise",
    failed_path: str | None = None,
) -> list[StreamingQuery]:
    """Start the lake query and both metric queries, as the settings switch them on.

    Events without a time fit no hour of the lake; they go to its ``rejects`` folder.
    Metrics go to Parquet tables below ``metrics_path``, or to the micro-batch
    writers which ``writer_for`` gives. ``on_error`` and ``failed_path``, the folder for the
    batches that "keep" stores, are those of ``sinks.metrics.guarded``.
    """
    queries = []
    if settings.enable_lake and lake_path:
        queries.append(lake.stream_lake(events, lake_path, settings))
        untimed = events.where(F.col("timestamp").isNull())
        queries.append(lake.stream_rejects(untimed, f"{lake_path}/rejects", settings))
    if not settings.enable_metrics:
        return queries
    frames = {
        "event-metrics-5min": metrics.event_metric_stream(events, settings, uniques),
        "user-metrics-1hr": metrics.user_metric_stream(events, settings),
    }
    for name, frame in frames.items():
        table = name.replace("-", "_")
        schema = TABLE_SCHEMAS[table]
        if writer_for is not None:
            run = run_of(frame.sparkSession, settings.checkpoint(name))
            writer = writer_for(table, schema, run)
            kept = f"{failed_path}/{table}" if failed_path else None
            query = metric_sinks.stream_batches(
                frame, writer, settings, name, on_error=on_error, failed_path=kept, run=run
            )
        elif metrics_path:
            path = f"{metrics_path}/{table}"
            query = metric_sinks.stream_table(frame, path, schema, settings, name)
        else:
            continue
        queries.append(query)
    return queries


def start_pipeline(
    records: DataFrame, settings: StreamSettings, landing_path: str | None = None, **metric_options
) -> list[StreamingQuery]:
    """From broker records: land accepted and rejected rows, and count the valid events.

    ``metric_options`` are those of ``start_jobs``.
    """
    queries = []
    if settings.enable_lake and landing_path:
        queries.append(stream_landing(records, landing_path, settings))
    checked = check_events(parse_payload(records))
    events = valid_events(checked, **record_defaults(checked))
    return queries + start_jobs(events, settings, **metric_options)


def run_until_stopped(queries: list[StreamingQuery], poll_seconds: int = 2) -> None:
    """Wait until the queries end; if one fails or on interrupt, stop the others.

    All queries are watched in turn, so no failure stays unseen behind a query
    which runs on. It is raised, for the scheduler to restart the whole job.
    """
    running = list(queries)
    try:
        while running:
            running = [q for q in running if not q.awaitTermination(poll_seconds)]
    except KeyboardInterrupt:
        pass
    finally:
        for query in queries:
            query.stop()
