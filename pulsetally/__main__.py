"""Command line: python -m pulsetally stream|backfill|tables|refresh|report --help."""

from __future__ import annotations

import argparse
from datetime import datetime
from functools import partial

from pyspark.sql import functions as F

from pulsetally.config import KafkaSettings, StreamSettings
from pulsetally.plans import reports
from pulsetally.plans.landing import append_landing, read_accepted
from pulsetally.plans.parts import refresh_tables
from pulsetally.plans.tables import build_metric_tables
from pulsetally.schema import METRIC_TABLES, SKETCH_TABLE, USER_METRIC_TABLE
from pulsetally.session import build_session
from pulsetally.sources import kafka
from pulsetally.sources.metric_tables import read_parquet, table_name
from pulsetally.streaming.jobs import run_until_stopped, start_pipeline
from pulsetally.streaming.one_pass import start_one_pass


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = build_session("event-metrics")
    args.run(spark, args)


def _stream(spark, args) -> None:
    """Kafka topic to landing folder and metric tables, until stopped."""
    source = KafkaSettings(
        args.brokers,
        args.topic,
        args.starting,
        args.max_offsets or None,
        args.min_partitions,
        fail_on_data_loss=args.fail_on_data_loss,
        security_protocol=args.security_protocol,
        sasl_mechanism=args.sasl_mechanism,
        sasl_username=args.sasl_username,
        sasl_password=_first_line(args.sasl_password_file),
    )
    settings = StreamSettings(
        args.checkpoints,
        state_partitions=args.state_partitions,
        dedup=args.dedup,
        enable_lake=not args.no_lake,
        enable_metrics=not args.no_metrics,
    )
    records = kafka.read_stream(spark, source)
    if args.parts:
        queries = [start_one_pass(records, settings, args.landing, args.parts)]
    else:
        queries = start_pipeline(records, settings, args.landing, metrics_path=args.tables)
    run_until_stopped(queries)


def _first_line(path: str | None) -> str | None:
    if path is None:
        return None
    with open(path, encoding="utf-8") as lines:
        return lines.readline().rstrip("\n")


def _backfill(spark, args) -> None:
    """Files with one JSON event per line to the landing folder."""
    append_landing(spark.read.text(args.files), args.landing)


def _tables(spark, args) -> None:
    """Metric tables for a range of days from the landing folder."""
    read = partial(read_accepted, spark, args.landing)
    build_metric_tables(spark, read, args.tables, args.start, args.end)


def _refresh(spark, args) -> None:
    """Metric tables from the parts of a one-pass stream, only the dates that changed."""
    for day in refresh_tables(spark, args.parts, args.tables):
        print(day.isoformat())


def _report(spark, args) -> None:
    """A report over the metric tables, as a line of JSON a row."""
    hours, as_of = args.hours, args.as_of

    def table(name: str):
        return read_parquet(spark, f"{args.tables}/{name}", hours, as_of)

    kinds = {
        "event-metrics": lambda: reports.event_metrics_report(
            {args.window: table(table_name(args.window))}, args.window, hours, args.event_type, args.platform, args.limit, as_of
        ),
        "user-metrics": lambda: reports.user_metrics_report(
            table(USER_METRIC_TABLE), hours, args.user, args.platform, args.limit, as_of
        ),
        "top-users": lambda: reports.top_users_report(table(USER_METRIC_TABLE), hours, args.limit, as_of),
        "distribution": lambda: reports.event_distribution_report(
            table(METRIC_TABLES["5min"]), hours, as_of, args.overlap
        ),
        "platforms": lambda: reports.platform_metrics_report(table(METRIC_TABLES["5min"]), hours, as_of, args.overlap),
        "platform-users": lambda: reports.platform_users_report(table(SKETCH_TABLE), hours, as_of),
    }
    for line in kinds[args.kind]().select(F.to_json(F.struct("*"))).toLocalIterator():
        print(line[0])


REPORTS = ("event-metrics", "user-metrics", "top-users", "distribution", "platforms", "platform-users")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pulsetally")
    commands = parser.add_subparsers(required=True)

    stream = commands.add_parser("stream", help=_stream.__doc__)
    stream.add_argument("--brokers", required=True)
    stream.add_argument("--topic", required=True)
    stream.add_argument("--starting", default="latest", choices=("latest", "earliest"))
    stream.add_argument("--max-offsets", type=int, default=10_000, help="records a trigger; 0: no cap")
    stream.add_argument("--fail-on-data-loss", action="store_true")
    stream.add_argument("--min-partitions", type=int)
    stream.add_argument("--state-partitions", type=int)
    stream.add_argument("--security-protocol", default="PLAINTEXT")
    stream.add_argument("--sasl-mechanism")
    stream.add_argument("--sasl-username")
    stream.add_argument("--sasl-password-file", help="the password is its first line")
    stream.add_argument("--dedup", action="store_true", help="drop repeated event ids within the watermark")
    stream.add_argument("--no-lake", action="store_true")
    stream.add_argument("--no-metrics", action="store_true")
    stream.add_argument("--parts", help="one query for all sinks: keep the tables' parts here, then run refresh")
    stream.add_argument("--checkpoints", required=True)
    stream.set_defaults(run=_stream)

    backfill = commands.add_parser("backfill", help=_backfill.__doc__)
    backfill.add_argument("--files", required=True)
    backfill.set_defaults(run=_backfill)

    tables = commands.add_parser("tables", help=_tables.__doc__)
    tables.add_argument("--start", type=datetime.fromisoformat)
    tables.add_argument("--end", type=datetime.fromisoformat)
    tables.set_defaults(run=_tables)

    refresh = commands.add_parser("refresh", help=_refresh.__doc__)
    refresh.add_argument("--parts", required=True)
    refresh.set_defaults(run=_refresh)

    report = commands.add_parser("report", help=_report.__doc__)
    report.add_argument("kind", choices=REPORTS)
    report.add_argument("--hours", type=int, default=24)
    report.add_argument("--limit", type=int, default=10)
    report.add_argument("--window", default="5min", choices=tuple(METRIC_TABLES))
    report.add_argument("--event-type")
    report.add_argument("--platform")
    report.add_argument("--user")
    report.add_argument("--overlap", default="literal", choices=("literal", "tumbling"))
    report.add_argument("--as-of", type=datetime.fromisoformat)
    report.set_defaults(run=_report)

    for command in (stream, backfill, tables):
        command.add_argument("--landing", required=True)
    for command in (stream, tables, refresh, report):
        command.add_argument("--tables", required=True)
    return parser


if __name__ == "__main__":
    main()
