"""One streaming query for all sinks: a micro-batch is read, parsed and checked once.

The checked rows of a micro-batch are cached (if there are several sinks) and written to the
landing folder and to the parts of the metric tables (``plans/parts.py``). Every sink has its own ledger
(``sinks/micro.py``), so a batch that is repeated after a crash between two sinks goes
to those only that lack it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsetally.config import StreamSettings
from pulsetally.plans import outcomes, parts
from pulsetally.plans.landing import ACCEPTED, LANDING_SCHEMA, PARTITIONS, landing_rows
from pulsetally.schema import EVENT_COLUMNS
from pulsetally.sinks.micro import pack, write_micro
from pulsetally.sources.folders import DATE, run_of
from pulsetally.streaming.start import start_query

NAME = "one-pass"
#: (folder, partition columns, rows to write from the checked rows)
Sink = tuple[str, tuple[str, ...], Callable[[DataFrame], DataFrame]]


def sinks(
    settings: StreamSettings, landing_path: str | None, parts_path: str | None, outcomes_path: str | None = None
) -> list[Sink]:
    """The sinks that the settings switch on and that have a folder."""
    found: list[Sink] = []
    if settings.enable_lake and landing_path:
        found.append((landing_path, PARTITIONS, lambda rows: rows.select(*LANDING_SCHEMA.names)))
    if outcomes_path:
        found.append((outcomes_path, (), outcomes.part_of))
    if settings.enable_metrics and parts_path:
        for name in parts.SCHEMAS:
            found.append((f"{parts_path.rstrip('/')}/{name}", (DATE,), _part_rows(name)))
    return found


def _part_rows(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: parts.part_of(rows.where(F.col(ACCEPTED)).select(*EVENT_COLUMNS), name)


def batch_writer(targets: list[Sink], run: str) -> Callable[[DataFrame, int], None]:
    """Writer of a micro-batch of records to all sinks that do not have it yet."""

    def write(records: DataFrame, batch_id: int) -> None:
        spark = records.sparkSession
        batch = tuple(c for c in (outcomes.BATCH_ID,) if c in records.columns)
        rows = landing_rows(records, batch)
        # One sink reads the rows once, and without a cache only the columns it needs are made.
        if len(targets) > 1:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for path, columns, select in targets:
                write_micro(lambda: select(rows), spark, path, columns, run, batch_id)
        finally:
            rows.unpersist()

    return write


def start_one_pass(
    records: DataFrame,
    settings: StreamSettings,
    landing_path: str | None = None,
    parts_path: str | None = None,
    name: str = NAME,
    outcomes_path: str | None = None,
) -> StreamingQuery:
    """Land broker records and keep the parts of the metric tables, with one parse of each record.

    With ``outcomes_path`` the counts of client batches (``plans/outcomes.py``) are kept too.

    Records without topic, partition and offset should carry an event id: a random one may
    differ between sinks when a lost executor takes cached rows along.
    """
    run = run_of(records.sparkSession, settings.checkpoint(name))
    targets = sinks(settings, landing_path, parts_path, outcomes_path)
    writer = records.writeStream.foreachBatch(batch_writer(targets, run))
    return start_query(records, writer, settings, name)


def pack_landing(spark, landing_path: str, keep_files: bool = False) -> int | None:
    """Rewrite landed micro-batches to a file an hour, while the stream goes on."""
    return pack(spark, landing_path, LANDING_SCHEMA, PARTITIONS, keep_files=keep_files)
