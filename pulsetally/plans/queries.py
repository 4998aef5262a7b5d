"""Every operator as a query over the given tables: (session, folder) -> frame.

Times are returned without a zone (UTC), as other engines hold them in files.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetally.config import StreamSettings
from pulsetally.functions import text
from pulsetally.operators import batches, decode, dedup, metrics, rollup, validate
from pulsetally.operators.decode import encode_events, parse_payload
from pulsetally.operators.dedup import dedup_events
from pulsetally.operators.projections import of_type, with_calendar
from pulsetally.plans import landing, outcomes, parts, reports, rolling, tables
from pulsetally.schema import (
    METRIC_KEY,
    METRIC_SCHEMA,
    METRIC_TABLES,
    SKETCH_TABLE,
    USER_COUNTERS,
    USER_METRIC_SCHEMA,
    USER_METRIC_TABLE,
)
from pulsetally.session import pin_utc, shared_dir
from pulsetally.sinks import lake as lake_sink
from pulsetally.sinks import lookup
from pulsetally.sinks import metrics as metric_sinks
from pulsetally.sinks.micro import files_by_partition
from pulsetally.sources import lake as lake_source
from pulsetally.sources.folders import read_dates, read_parts
from pulsetally.sources.event_tables import as_events, read_table, stream_table
from pulsetally.sources.metric_tables import newest_per_key, pick_table, read_parquet
from pulsetally.streaming import metrics as metric_streams
from pulsetally.streaming import one_pass, state
from pulsetally.streaming.start import start_file_query

Query = Callable[[SparkSession, str], DataFrame]

# The data ends the day before.
AS_OF = "2024-01-31 00:00:00"
DAY, WEEK = 24, 168
EVENT_FIELDS = [
    "event_id", "event_type", "user_id", "content_id", "platform", "timestamp",
    "session_id", "device_type", "location",
]
METRIC_FIELDS = [
    "window_start", "window_end", "event_type", "platform", "event_count", "unique_users",
]
USER_FIELDS = ["window_start", "window_end", "user_id", "platform", "total_events", *USER_COUNTERS]


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _events(spark: SparkSession, folder: str, map_types: bool = True) -> DataFrame:
    pin_utc(spark)
    return as_events(read_table(spark, folder), map_types)


def _records(events: DataFrame) -> DataFrame:
    """Events as broker records; the event id is the offset.

    They are dealt over all cores, as the table may be a few row groups, and so a few tasks,
    and encoding, parsing and checking a record takes far longer than moving it.
    """
    offset = F.col("event_id").cast("bigint")
    tasks = 3 * events.sparkSession.sparkContext.defaultParallelism
    return (
        events.repartition(tasks, "event_id", "timestamp")
        .withColumn("offset", offset)
        .transform(encode_events, keep=("batch_id", "offset", "timestamp"))
        .withColumns({"topic": F.lit("events"), "partition": F.lit(0)})
    )


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _plain(frame: DataFrame, *columns: str | Column) -> DataFrame:
    """Chosen columns, with times as zone-free times."""
    picked = frame.select(*columns) if columns else frame
    times = {c: F.col(c).cast("timestamp_ntz") for c, t in picked.dtypes if t == "timestamp"}
    return picked.withColumns(times) if times else picked


def _reasons() -> Column:
    return F.array_join("reasons", ",").alias("reasons")


# --- decode, validate, publish -------------------------------------------------


@_query
def decode_events(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decode.decode_events(_records(_events(spark, folder)))
    return _plain(decoded, *EVENT_FIELDS, F.col("metadata")["k"].alias("metadata_k"))


@_query
def publish_payload(spark: SparkSession, folder: str) -> DataFrame:
    records = encode_events(_events(spark, folder))
    fields = [
        F.get_json_object("value", f"$.{c}").alias(c) for c in EVENT_FIELDS
    ]
    return records.select("key", *fields, F.get_json_object("value", "$.metadata.k").alias("metadata_k"))


@_query
def validate_valid(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.check_events(parse_payload(_records(_events(spark, folder, False))))
    valid = validate.valid_events(checked, **validate.record_defaults(checked))
    return _plain(valid, *EVENT_FIELDS, F.col("metadata")["k"].alias("metadata_k"))


@_query
def validate_rejects(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.check_events(parse_payload(_records(_events(spark, folder, False))))
    return validate.rejected_records(checked).select("event_id", "event_type", _reasons())


@_query
def validate_raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as payloads: whatever is not JSON must come out as malformed."""
    records = _table(spark, folder, "documents").select("doc_id", F.col("text").alias("value"))
    return validate.check_events(parse_payload(records)).select("doc_id", _reasons())


def _text_of(length: int) -> str:
    return '"' + "x" * length + '"'


#: Reasons, and the fields of a payload that are not as they should be: JSON, or None for a missing one.
VARIANTS: tuple[tuple[str, dict[str, str | None]], ...] = (
    ("", {}),
    ("event_type_missing", {"event_type": None}),
    ("event_type_unknown", {"event_type": '"bookmark"'}),
    ("user_id_missing", {"user_id": "null"}),
    ("user_id_not_text", {"user_id": "12"}),
    ("user_id_length", {"user_id": '""'}),
    ("user_id_length", {"user_id": _text_of(101)}),
    ("user_id_blank", {"user_id": '" \\t\\u2003 "'}),
    ("platform_missing", {"platform": None}),
    ("platform_unknown", {"platform": '"Web"'}),
    ("event_id_not_text", {"event_id": "17.5"}),
    ("content_id_not_text", {"content_id": "true"}),
    ("session_id_not_text", {"session_id": '["s"]'}),
    ("device_type_not_text", {"device_type": '{"d": 1}'}),
    ("location_not_text", {"location": "7"}),
    ("content_id_too_long", {"content_id": _text_of(101)}),
    ("session_id_too_long", {"session_id": _text_of(101)}),
    ("device_type_too_long", {"device_type": _text_of(51)}),
    ("location_too_long", {"location": _text_of(101)}),
    ("timestamp_malformed", {"timestamp": '"last week"'}),
    ("metadata_not_object", {"metadata": "[1]"}),
    ("metadata_too_large", {"metadata": '{"k": ' + _text_of(992) + "}"}),
    ("", {"metadata": '{"k": ' + _text_of(991) + "}"}),
    ("", {"user_id": _text_of(100), "device_type": _text_of(50), "location": None, "content_id": "null"}),
    ("user_id_blank,platform_missing,location_too_long", {"user_id": '" "', "platform": None, "location": _text_of(999)}),
    ("payload_malformed", {"event_id": '"cut off'}),
)


def _variant_payload(fields: dict[str, str | None]) -> str:
    """A payload in which ``@id`` stands for the event's number."""
    usual = {name: f'"{name} @id"' for name in ("event_id", "user_id", "content_id", "session_id", "device_type", "location")}
    usual |= {"event_type": '"like"', "platform": '"ios"', "timestamp": '"2024-01-15T10:00:00Z"', "metadata": '{"k": @id}'}
    given = {name: value for name, value in (usual | fields).items() if value is not None}
    return "{" + ", ".join(f'"{name}": {value}' for name, value in given.items()) + "}"


@_query
def validate_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every reason there is: each event is sent in one of many forms, good and broken."""
    pin_utc(spark)
    number = F.col("event_id")
    forms = F.array(*[F.lit(_variant_payload(fields)) for _, fields in VARIANTS])
    form = F.element_at(forms, (number % len(VARIANTS) + 1).cast("int"))
    value = F.replace(form, F.lit("@id"), number.cast("string"))
    records = read_table(spark, folder).select(number.alias("offset"), value.alias("value"))
    return validate.check_events(parse_payload(records)).select("offset", _reasons())


def _document_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as events which carry their whole text in several fields."""
    value = F.to_json(
        F.struct(
            F.lit("view").alias("event_type"),
            F.concat(F.lit("  "), "source", F.lit(" \t")).alias("user_id"),
            F.col("text").alias("content_id"),
            F.col("lang").alias("platform"),
            F.col("text").alias("location"),
            F.col("source").alias("device_type"),
            F.struct("text").alias("metadata"),
        )
    )
    return _table(spark, folder, "documents").select("doc_id", value.alias("value"))


@_query
def validate_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Length, domain and size rules over whole texts."""
    checked = validate.check_events(parse_payload(_document_payloads(spark, folder)))
    return checked.select("doc_id", _reasons(), text.strip(F.col("user_id")).alias("user_id"))


@_query
def default_event_id(spark: SparkSession, folder: str) -> DataFrame:
    """Events sent without id, time and metadata get them from their record."""
    events = _events(spark, folder)
    nothing = F.lit(None)
    bare = events.withColumns(
        {
            "offset": F.col("event_id").cast("bigint"),
            "sent": F.col("timestamp"),
            "event_id": F.when(F.length("event_id") % 2 == 0, F.lit("")),
            "timestamp": nothing.cast("timestamp"),
            "metadata": nothing.cast("map<string,string>"),
        }
    )
    records = encode_events(bare, keep=("offset", "sent")).select(
        "offset", "value", F.col("sent").alias("timestamp"),
        F.lit("events").alias("topic"), F.lit(0).alias("partition"),
    )
    checked = validate.check_events(parse_payload(records))
    valid = validate.valid_events(checked, **validate.record_defaults(checked), keep=("offset",))
    return _plain(valid, "offset", "event_id", "timestamp", F.size("metadata").alias("metadata_size"))


@_query
def batch_outcome(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.check_events(parse_payload(_records(_events(spark, folder, False))))
    outcome = batches.batch_outcome(checked, validate.is_valid())
    return outcome.withColumn("errors", F.array_join("errors", ","))


def _turn_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as client batches: a turn is an event with its whole text as metadata."""
    value = F.to_json(
        F.struct(
            F.lit("comment").alias("event_type"),
            F.col("role").alias("user_id"),
            F.lit("web").alias("platform"),
            F.struct("text").alias("metadata"),
        )
    )
    turns = _table(spark, folder, "conversations")
    return turns.select(F.col("conv_id").alias("batch_id"), "turn", value.alias("value"))


@_query
def batch_outcome_conversations(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.check_events(parse_payload(_turn_payloads(spark, folder)))
    outcome = batches.batch_outcome(checked, validate.is_valid())
    return outcome.withColumn("errors", F.array_join("errors", ","))


@_query
def batch_atomic(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of the conversations in which every turn is valid."""
    checked = validate.check_events(parse_payload(_turn_payloads(spark, folder)))
    kept = batches.atomic_batches(checked, validate.is_valid())
    return kept.select("batch_id", "turn", "user_id", F.col("given_metadata")["text"].alias("text"))


@_query
def batch_outcome_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of batches below and beyond the size limit; some rows have no batch."""
    quantity = F.concat(F.lit("quantity-"), F.col("l_quantity").cast("int").cast("string"))
    supplier = F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"))
    rows = _table(spark, folder, "lineitem").select(
        F.explode(F.array(quantity, supplier, F.lit(None).cast("string"))).alias("batch_id"),
        (F.col("l_linenumber") < 7).alias("ok"),
    )
    outcome = batches.batch_outcome(rows, F.col("ok"))
    return outcome.withColumn("errors", F.array_join("errors", ","))


@_query
def dedup_batch_differing(spark: SparkSession, folder: str) -> DataFrame:
    """Of copies that differ in their time the earliest stays; one id has very many."""
    events = _events(spark, folder).withColumn("event_id", F.concat(F.lit("id-"), F.col("user_id")))
    return _plain(dedup_events(events.drop("batch_id")), "event_id", "timestamp")


@_query
def batch_size_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes against the limit; every line is in a supplier's and a quantity's batch."""
    supplier = F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"))
    quantity = F.concat(F.lit("quantity-"), F.col("l_quantity").cast("int").cast("string"))
    rows = _table(spark, folder, "lineitem").select(
        F.explode(F.array(supplier, quantity)).alias("batch_id")
    )
    return batches.batch_sizes(rows, F.lit(True)).select("batch_id", "total_events", "size_ok")


# --- lake ----------------------------------------------------------------------


@_query
def lake_partition_columns(spark: SparkSession, folder: str) -> DataFrame:
    return with_calendar(_events(spark, folder)).select("event_id", "year", "month", "day", "hour")


def _written_lake(spark: SparkSession, folder: str) -> str:
    path = shared_dir(spark, "lake")
    lake_sink.append_lake(_events(spark, folder), path)
    return path


@_query
def lake_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    read = lake_source.read_lake(spark, _written_lake(spark, folder))
    return _plain(read, *EVENT_FIELDS, F.col("metadata")["k"].alias("metadata_k"), "year", "hour")


@_query
def lake_roundtrip_pruned(spark: SparkSession, folder: str) -> DataFrame:
    path = _written_lake(spark, folder)
    start, end = datetime(2024, 1, 9, 6, 30), datetime(2024, 1, 17)
    return _plain(lake_source.read_lake(spark, path, start, end), *EVENT_FIELDS)


@_query
def landing_accepted(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "landing")
    landing.append_landing(_records(_events(spark, folder, False)), path)
    return _plain(landing.read_accepted(spark, path), *EVENT_FIELDS, "year", "month", "day", "hour")


@_query
def landing_rejected(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "landing")
    landing.append_landing(_records(_events(spark, folder, False)), path)
    event_id = F.col("raw_fields")["event_id"].alias("event_id")
    return landing.read_rejected(spark, path).select(event_id, _reasons(), "year", "month", "day", "hour")


# --- metrics -------------------------------------------------------------------


@_query
def event_metrics_5min_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_sliding(_events(spark, folder)), *METRIC_FIELDS)


def _sliding(events: DataFrame, uniques: metrics.Uniques = "exact") -> DataFrame:
    return metrics.event_metrics(events, metrics.FIVE_MINUTES, metrics.ONE_MINUTE, uniques)


@_query
def event_metrics_5min_sliding_approx(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_sliding(_events(spark, folder), "approx"), *METRIC_FIELDS)


@_query
def event_metrics_5min_as_coded(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_sliding(_events(spark, folder), "as_coded"), *METRIC_FIELDS)


@_query
def event_metrics_5min_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(metrics.event_metrics(_events(spark, folder)), *METRIC_FIELDS)


@_query
def event_metrics_1hr(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(metrics.event_metrics(_events(spark, folder), metrics.ONE_HOUR), *METRIC_FIELDS)


@_query
def event_metrics_1day(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(metrics.event_metrics(_events(spark, folder), metrics.ONE_DAY), *METRIC_FIELDS)


def _rollup(spark: SparkSession, folder: str, name: str) -> DataFrame:
    parts = shared_dir(spark, "metric-parts")
    rollup.write_intermediates(_events(spark, folder), parts)
    return _plain(pick_table(rollup.metric_tables(spark, parts), name), *METRIC_FIELDS)


@_query
def rollup_5min(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup(spark, folder, "5min")


@_query
def rollup_1hr(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup(spark, folder, "1hr")


@_query
def rollup_1day(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup(spark, folder, "1day")


@_query
def user_metrics_1hr(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(metrics.user_metrics(_events(spark, folder)), *USER_FIELDS)


@_query
def user_metrics_1hr_as_coded(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(metrics.user_metrics(_events(spark, folder), as_coded=True), *USER_FIELDS)


@_query
def events_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.events_per_user(_events(spark, folder))


@_query
def events_per_window_type(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(metrics.events_per_window_type(_events(spark, folder)))


@_query
def filter_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(of_type(_events(spark, folder), "like"), *EVENT_FIELDS)


# --- reports -------------------------------------------------------------------


def _recent(spark: SparkSession, folder: str, hours: int) -> DataFrame:
    return reports.recent_events(_events(spark, folder), hours, AS_OF)


def _event_report(
    spark: SparkSession, folder: str, granularity: str = "5min", hours: int = DAY, **options
) -> DataFrame:
    recent = _recent(spark, folder, hours)
    tables = {
        "5min": _sliding(recent),
        "1hr": metrics.event_metrics(recent, metrics.ONE_HOUR),
        "1day": metrics.event_metrics(recent, metrics.ONE_DAY),
    }
    report = reports.event_metrics_report(tables, granularity, hours, as_of=AS_OF, **options)
    return _plain(report, *METRIC_FIELDS)


@_query
def report_event_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _event_report(spark, folder)


@_query
def report_event_metrics_1hr(spark: SparkSession, folder: str) -> DataFrame:
    return _event_report(spark, folder, "1hr", WEEK, limit=1000)


@_query
def report_event_metrics_1day(spark: SparkSession, folder: str) -> DataFrame:
    return _event_report(spark, folder, "1day", WEEK)


@_query
def report_event_metrics_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _event_report(
        spark, folder, hours=WEEK, event_type="like", platform="web", limit=1000
    )


def _user_report(spark: SparkSession, folder: str, hours: int, **options) -> DataFrame:
    users = metrics.user_metrics(_recent(spark, folder, hours))
    return _plain(reports.user_metrics_report(users, hours, as_of=AS_OF, **options), *USER_FIELDS)


@_query
def report_user_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _user_report(spark, folder, DAY)


@_query
def report_user_metrics_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _user_report(spark, folder, WEEK, user_id="user_7", platform="ios", limit=1000)


@_query
def report_top_users(spark: SparkSession, folder: str) -> DataFrame:
    users = metrics.user_metrics(_recent(spark, folder, WEEK))
    return reports.top_users_report(users, WEEK, 100, AS_OF)


@_query
def report_event_distribution(spark: SparkSession, folder: str) -> DataFrame:
    table = _sliding(_recent(spark, folder, WEEK), "as_coded")
    return reports.event_distribution_report(table, WEEK, AS_OF)


@_query
def report_event_distribution_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    table = _sliding(_recent(spark, folder, WEEK), "as_coded")
    return reports.event_distribution_report(table, WEEK, AS_OF, "tumbling")


@_query
def report_platform_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return reports.platform_metrics_report(_sliding(_recent(spark, folder, WEEK)), WEEK, AS_OF)


@_query
def report_platform_metrics_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    table = _sliding(_recent(spark, folder, WEEK))
    return reports.platform_metrics_report(table, WEEK, AS_OF, "tumbling")


@_query
def report_platform_metrics_exact(spark: SparkSession, folder: str) -> DataFrame:
    return reports.platform_users_exact(_events(spark, folder), WEEK, AS_OF)


@_query
def report_platform_metrics_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users of the range as estimated by merged sketches, against the exact counts.

    Three standard errors of the sketches are 5 %; those of some hundred users are nearly exact.
    """
    recent = _recent(spark, folder, WEEK)
    table = metrics.event_metrics(recent, metrics.FIVE_MINUTES, uniques="sketch")
    estimates = reports.platform_users_report(table, WEEK, AS_OF)
    exact = reports.platform_users_exact(recent, WEEK, AS_OF)
    return reports.against_exact(estimates, exact, 5)


# --- reports over stored tables --------------------------------------------------


def _stored(spark: SparkSession, folder: str) -> Callable[[str, int], DataFrame]:
    """The metric tables of the last days, written; gives a reader of (table, hours back)."""
    path, events = shared_dir(spark, "tables"), _events(spark, folder)

    def read(start: datetime | None, end: datetime | None) -> DataFrame:
        return events.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))

    tables.build_metric_tables(spark, read, path, datetime(2024, 1, 24), datetime(2024, 1, 31))
    return lambda table, hours: read_parquet(spark, f"{path}/{table}", hours, AS_OF)


@_query
def report_event_metrics_stored(spark: SparkSession, folder: str) -> DataFrame:
    table = _stored(spark, folder)(METRIC_TABLES["5min"], DAY)
    report = reports.event_metrics_report({"5min": table}, "5min", DAY, as_of=AS_OF)
    return _plain(reports.with_totals(report.select(*METRIC_FIELDS), DAY, "event_count"))


@_query
def report_user_metrics_stored(spark: SparkSession, folder: str) -> DataFrame:
    table = _stored(spark, folder)(USER_METRIC_TABLE, DAY)
    report = reports.user_metrics_report(table, DAY, as_of=AS_OF)
    return _plain(reports.with_totals(report.select(*USER_FIELDS), DAY, "total_events"))


@_query
def report_top_users_stored(spark: SparkSession, folder: str) -> DataFrame:
    table = _stored(spark, folder)(USER_METRIC_TABLE, WEEK)
    return reports.with_totals(reports.top_users_report(table, WEEK, 100, AS_OF), WEEK, "total_events")


@_query
def report_event_distribution_stored(spark: SparkSession, folder: str) -> DataFrame:
    table = _stored(spark, folder)(METRIC_TABLES["5min"], WEEK)
    return reports.with_totals(reports.event_distribution_report(table, WEEK, AS_OF), WEEK, "total_count")


@_query
def report_platform_metrics_stored(spark: SparkSession, folder: str) -> DataFrame:
    table = _stored(spark, folder)(METRIC_TABLES["5min"], WEEK)
    return reports.with_totals(reports.platform_metrics_report(table, WEEK, AS_OF), WEEK, "total_events")


@_query
def report_platform_metrics_sketch_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The estimate from the sketches of the stored hourly table."""
    table = _stored(spark, folder)(SKETCH_TABLE, WEEK)
    return reports.with_totals(reports.platform_users_report(table, WEEK, AS_OF), WEEK, "total_events")


@_query
def report_user_metrics_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A user's report from a table laid out for look-ups."""
    path = shared_dir(spark, "lookup")
    lookup.write_lookup(metrics.user_metrics(_events(spark, folder)), path, USER_METRIC_SCHEMA, buckets=4)
    rows = lookup.look_up(spark, path, USER_METRIC_SCHEMA, "user_7", hours_back=WEEK, as_of=AS_OF)
    report = reports.user_metrics_report(rows, WEEK, user_id="user_7", platform="ios", limit=1000, as_of=AS_OF)
    return _plain(report, *USER_FIELDS)


@_query
def top_users_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Top users of the last seven days for each day; a tenth of one day's events comes after all were rolled."""
    path, events = shared_dir(spark, "rolling"), _events(spark, folder)
    first, last = events.agg(F.to_date(F.min("timestamp")), F.to_date(F.max("timestamp"))).first()
    days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    changed = days[len(days) // 2]
    late = (F.to_date("timestamp") == F.lit(changed)) & (F.col("event_id").cast("bigint") % 10 == 0)
    rolling.store_days(metrics.user_metrics(events.where(~late)), path, days)
    rolling.roll(spark, path, first, last)
    rolling.store_days(metrics.user_metrics(events), path, [changed])
    rolling.roll(spark, path, changed, last)
    tops = [rolling.top_users(spark, path, day).withColumn("day", F.lit(day)) for day in days]
    return reduce(DataFrame.unionByName, tops)


# --- sinks and streams -----------------------------------------------------------


@_query
def idempotent_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A table whose batch was written twice holds it once."""
    path = shared_dir(spark, "replayed")
    table = metrics.event_metrics(_events(spark, folder), metrics.ONE_HOUR)
    write = metric_sinks.parquet_batches(path, METRIC_SCHEMA)
    write(table, 7)
    write(table, 7)
    return _plain(spark.read.parquet(path), *METRIC_FIELDS)


@_query
def newest_batch_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Of two batches with the same keys the later one counts."""
    path = shared_dir(spark, "versions")
    events = _events(spark, folder)
    write = metric_sinks.parquet_batches(path, METRIC_SCHEMA)
    write(metrics.event_metrics(events, metrics.ONE_DAY, uniques="as_coded"), 1)
    write(metrics.event_metrics(events, metrics.ONE_DAY), 2)
    return _plain(newest_per_key(spark.read.parquet(path), METRIC_KEY), *METRIC_FIELDS)


@_query
def replay_after_new_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """A second run starts at batch 0 again: it adds its rows and leaves those of the first."""
    path = shared_dir(spark, "runs")
    table = metrics.event_metrics(_events(spark, folder), metrics.ONE_DAY)
    for run, platforms in (("1", ["web", "ios"]), ("2", ["android", "mobile_web"])):
        write = metric_sinks.parquet_batches(path, METRIC_SCHEMA, run)
        for _ in range(2):
            write(table.where(F.col("platform").isin(platforms)), 0)
    return _plain(newest_per_key(spark.read.parquet(path), METRIC_KEY), *METRIC_FIELDS)


@_query
def compaction_in_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Batches merged one by one; the second has other keys of the same dates."""
    batches, path = shared_dir(spark, "batches"), shared_dir(spark, "compacted")
    table = metrics.event_metrics(_events(spark, folder), metrics.ONE_DAY)
    write = metric_sinks.parquet_batches(batches, METRIC_SCHEMA)
    for batch, platforms in enumerate((["web", "ios"], ["android", "mobile_web"])):
        write(table.where(F.col("platform").isin(platforms)), batch)
        step = spark.read.parquet(batches).where(F.col("batch_id") == batch)
        metric_sinks.compact_batches(step, path, METRIC_SCHEMA, METRIC_KEY)
    return _plain(read_dates(spark, path, METRIC_SCHEMA), *METRIC_FIELDS)


@_query
def compaction_other_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Batches merged one by one that hold different dates, the first half of the month last."""
    batches, path = shared_dir(spark, "batches"), shared_dir(spark, "compacted")
    table = metrics.event_metrics(_events(spark, folder), metrics.ONE_DAY)
    write = metric_sinks.parquet_batches(batches, METRIC_SCHEMA)
    early = F.dayofmonth("window_start") <= 15
    for batch, part in enumerate((~early, early)):
        write(table.where(part), batch)
        step = spark.read.parquet(batches).where(F.col("batch_id") == batch)
        metric_sinks.compact_batches(step, path, METRIC_SCHEMA, METRIC_KEY)
    return _plain(read_dates(spark, path, METRIC_SCHEMA), *METRIC_FIELDS)


@_query
def append_after_build(spark: SparkSession, folder: str) -> DataFrame:
    """Rows appended to dates that were built before are read next to the built ones."""
    path = shared_dir(spark, "built")
    table = metrics.event_metrics(_events(spark, folder), metrics.ONE_DAY)
    built, later = _halves(table)
    metric_sinks.replace_table(built, path, METRIC_SCHEMA)
    metric_sinks.append_table(later, path, METRIC_SCHEMA)
    return _plain(read_dates(spark, path, METRIC_SCHEMA), *METRIC_FIELDS)


@_query
def stream_after_build(spark: SparkSession, folder: str) -> DataFrame:
    """A stream's windows of dates that were built from half of the events take their place."""
    settings, path = _settings(spark), shared_dir(spark, "built")
    half = _events(spark, folder).where(F.col("event_id").cast("bigint") % 2 == 0)
    metric_sinks.replace_table(metrics.user_metrics(half), path, USER_METRIC_SCHEMA)
    frame = metric_streams.user_metric_stream(_stream(spark, folder), settings)
    metric_sinks.stream_user_metrics(frame, path, settings).awaitTermination()
    last = _events(spark, folder).agg(F.date_trunc("hour", F.max("timestamp")).alias("last"))
    rows = read_dates(spark, path, USER_METRIC_SCHEMA).join(F.broadcast(last))  # one row
    return _plain(rows.where("window_start < last - INTERVAL 1 HOUR"), *USER_FIELDS)


@_query
def failed_batch_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """A batch whose write fails is kept, the next one is written, and a replay adds the first."""
    path, kept = shared_dir(spark, "table"), shared_dir(spark, "failed")
    table = metrics.event_metrics(_events(spark, folder), metrics.ONE_DAY)
    write = metric_sinks.parquet_batches(path, METRIC_SCHEMA)

    def down(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            raise OSError("the table's store is down")
        write(batch, batch_id)

    guarded = metric_sinks.guarded(down, "metrics", "keep", kept)
    for batch_id, part in enumerate(_halves(table)):
        guarded(part, batch_id)
    metric_sinks.replay_failed(spark, kept, lambda run: write)
    return _plain(newest_per_key(spark.read.parquet(path), METRIC_KEY), *METRIC_FIELDS)


def _stream(spark: SparkSession, folder: str, map_types: bool = True) -> DataFrame:
    pin_utc(spark)
    return as_events(stream_table(spark, folder), map_types)


def _settings(spark: SparkSession, **options) -> StreamSettings:
    """Read all there is once; state is spread over all cores."""
    return StreamSettings(
        shared_dir(spark, "checkpoints"),
        available_now=True,
        state_partitions=spark.sparkContext.defaultParallelism,
        **options,
    )


def _event_stream(spark: SparkSession, folder: str, uniques: metrics.Uniques) -> DataFrame:
    settings, path = _settings(spark), shared_dir(spark, "stream-metrics")
    frame = metric_streams.event_metric_stream(_stream(spark, folder), settings, uniques)
    metric_sinks.stream_event_metrics(frame, path, settings).awaitTermination()
    return _plain(read_dates(spark, path, METRIC_SCHEMA), *METRIC_FIELDS)


@_query
def stream_event_metrics_5min(spark: SparkSession, folder: str) -> DataFrame:
    return _event_stream(spark, folder, "approx")


@_query
def stream_event_metrics_5min_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _event_stream(spark, folder, "exact")


@_query
def stream_user_metrics_1hr(spark: SparkSession, folder: str) -> DataFrame:
    settings, path = _settings(spark), shared_dir(spark, "stream-users")
    frame = metric_streams.user_metric_stream(_stream(spark, folder), settings)
    metric_sinks.stream_user_metrics(frame, path, settings).awaitTermination()
    return _plain(read_dates(spark, path, USER_METRIC_SCHEMA), *USER_FIELDS)


@_query
def dedup_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every event sent twice comes out once."""
    twice = _events(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _plain(dedup_events(twice), *EVENT_FIELDS)


@_query
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event sent twice comes out once."""
    settings, path = _settings(spark, dedup=True), shared_dir(spark, "stream-dedup")
    twice = _stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = metric_streams.prepared(twice, settings).select(*EVENT_FIELDS)
    start_file_query(once, path, settings, "dedup").awaitTermination()
    return _plain(read_parts(spark, path, once.schema), *EVENT_FIELDS)


SESSION = timedelta(hours=6)


def _few_ids(events: DataFrame) -> DataFrame:
    """Events with an id a user, so that ids have many copies that differ in their time."""
    return events.withColumn("event_id", F.concat(F.lit("id-"), F.col("user_id"))).drop("batch_id")


@_query
def dedup_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest of the copies of an id that follow each other within six hours."""
    kept = dedup.dedup_sessions(_few_ids(_events(spark, folder)), SESSION)
    return _plain(kept, "event_id", "timestamp", "content_id")


@_query
def stream_dedup_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream, for the sessions it has closed."""
    settings, path = _settings(spark), shared_dir(spark, "stream-sessions")
    marked = metric_streams.prepared(_few_ids(_stream(spark, folder)), settings)
    kept = dedup.dedup_sessions(marked, SESSION).select(*EVENT_FIELDS)
    start_file_query(kept, path, settings, "dedup-sessions").awaitTermination()
    return _plain(read_parts(spark, path, kept.schema), "event_id", "timestamp", "content_id")


@_query
def stream_open_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that a stream has counted and not yet emitted, out of its state."""
    settings, path, name = _settings(spark), shared_dir(spark, "stream-users"), "user-metrics-1hr"
    frame = metric_streams.user_metric_stream(_stream(spark, folder), settings)
    metric_sinks.stream_user_metrics(frame, path, settings, name).awaitTermination()
    return _plain(state.open_user_windows(spark, settings.checkpoint(name)), *USER_FIELDS)


@_query
def stream_lake(spark: SparkSession, folder: str) -> DataFrame:
    settings, path = _settings(spark), shared_dir(spark, "stream-lake")
    lake_sink.stream_lake(_stream(spark, folder), path, settings).awaitTermination()
    return _plain(lake_source.read_lake(spark, path), *EVENT_FIELDS, "year", "month", "day", "hour")


@_query
def stream_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected records of a stream, counted by type and reason."""
    settings, path = _settings(spark), shared_dir(spark, "stream-landing")
    records = _records(_stream(spark, folder, False))
    landing.stream_landing(records, path, settings).awaitTermination()
    accepted = landing.read_accepted(spark, path).select("event_type", F.lit("").alias("reasons"))
    raw_type = F.col("raw_fields")["event_type"].alias("event_type")
    rejected = landing.read_rejected(spark, path).select(raw_type, _reasons())
    both = accepted.unionByName(rejected)
    return both.groupBy("event_type", "reasons").agg(F.count(F.lit(1)).alias("records"))


def _halves(frame: DataFrame) -> list[DataFrame]:
    """The rows in two parts, which together are all of them."""
    first = F.col("platform").isin("web", "ios")
    return [frame.where(first), frame.where(~first)]


@_query
def lake_stream_and_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the events by a stream, half by a backfill, into one lake."""
    settings, path = _settings(spark), shared_dir(spark, "shared-lake")
    streamed, _ = _halves(_stream(spark, folder))
    _, filled = _halves(_events(spark, folder))
    lake_sink.stream_lake(streamed, path, settings).awaitTermination()
    lake_sink.append_lake(filled, path)
    return _plain(lake_source.read_lake(spark, path), *EVENT_FIELDS, "year", "month", "day", "hour")


@_query
def landing_stream_and_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """The same for records, the backfill first; accepted and rejected ones with their offsets."""
    settings, path = _settings(spark), shared_dir(spark, "shared-landing")
    streamed, _ = _halves(_stream(spark, folder, False))
    _, filled = _halves(_events(spark, folder, False))
    landing.append_landing(_records(filled), path)
    landing.stream_landing(_records(streamed), path, settings).awaitTermination()
    accepted = landing.read_accepted(spark, path).select("event_id", F.lit("").alias("reasons"))
    offset = F.col("record")["offset"].alias("event_id")
    return accepted.unionByName(landing.read_rejected(spark, path).select(offset, _reasons()))


@_query
def landing_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every record again, from accepted rows and from the payloads of rejected ones."""
    path = shared_dir(spark, "landing")
    landing.append_landing(_records(_events(spark, folder, False)), path)
    payload = F.col("payload").cast("string")
    fields = [F.get_json_object(payload, f"$.{c}").alias(c) for c in ("event_id", "event_type", "user_id", "platform")]
    accepted = landing.read_accepted(spark, path).select("event_id", "event_type", "user_id", "platform")
    return accepted.unionByName(landing.read_rejected(spark, path).select(*fields))


@_query
def tables_after_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream fills the user table, then a batch job builds some of its days anew."""
    settings, path = _settings(spark), shared_dir(spark, "tables")
    table = f"{path}/{USER_METRIC_TABLE}"
    frame = metric_streams.user_metric_stream(_stream(spark, folder), settings)
    metric_sinks.stream_user_metrics(frame, table, settings).awaitTermination()
    events = _events(spark, folder)

    def read(start: datetime | None, end: datetime | None) -> DataFrame:
        return events.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))

    tables.build_metric_tables(spark, read, path, datetime(2024, 1, 10), datetime(2024, 1, 20))
    return _plain(read_parquet(spark, table), *USER_FIELDS)


# --- one pass over the records for all sinks ------------------------------------------


def _one_pass(
    spark: SparkSession,
    records: DataFrame,
    landing_path: str | None,
    parts_path: str | None,
    outcomes_path: str | None = None,
) -> None:
    query = one_pass.start_one_pass(
        records, _settings(spark), landing_path, parts_path, outcomes_path=outcomes_path
    )
    query.awaitTermination()


def _streamed_outcomes(spark: SparkSession, folder: str) -> str:
    """The outcomes of two streams, each of which has a part of every client batch."""
    pin_utc(spark)
    path = shared_dir(spark, "outcomes")
    for half in _halves(_stream(spark, folder, False)):
        _one_pass(spark, _records(half), None, None, path)
    return path


@_query
def stream_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of client batches whose rows came in several micro-batches."""
    rows = outcomes.read_outcomes(spark, _streamed_outcomes(spark, folder))
    return rows.withColumn("errors", F.array_join("errors", ","))


@_query
def stream_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Records by reason, after the parts are packed."""
    path = _streamed_outcomes(spark, folder)
    outcomes.pack_outcomes(spark, path)
    return outcomes.read_reasons(spark, path)


def _landing_and_parts(spark: SparkSession) -> tuple[str, str]:
    return shared_dir(spark, "landing"), shared_dir(spark, "parts")


@_query
def stream_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """One query lands records and keeps all tables: the rows of each, in common columns."""
    pin_utc(spark)
    landing_path, parts_path = _landing_and_parts(spark)
    tables_path = shared_dir(spark, "tables")
    _one_pass(spark, _records(_stream(spark, folder, False)), landing_path, parts_path)
    parts.refresh_tables(spark, parts_path, tables_path)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    accepted = landing.read_accepted(spark, landing_path).select(
        F.lit("accepted").alias("source"), F.col("timestamp").alias("window_start"), F.col("event_id").alias("name"),
        "platform", one.alias("n"), none.alias("m"),
    )
    rejected = landing.read_rejected(spark, landing_path).select(
        F.lit("rejected"), F.lit(None).cast("timestamp"), F.col("record")["offset"], _reasons(), one, none
    )
    rows = accepted.union(rejected)
    for name in METRIC_TABLES.values():
        table = read_parquet(spark, f"{tables_path}/{name}")
        rows = rows.union(table.select(F.lit(name), "window_start", "event_type", "platform", "event_count", "unique_users"))
    users = read_parquet(spark, f"{tables_path}/{USER_METRIC_TABLE}")
    return _plain(rows.union(users.select(F.lit(USER_METRIC_TABLE), "window_start", "user_id", "platform", "total_events", "views")))


@_query
def lake_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Streamed, packed, streamed again: every event once, and the files its hour has."""
    pin_utc(spark)
    path, _ = _landing_and_parts(spark)
    first, second = _halves(_stream(spark, folder))
    _one_pass(spark, _records(first), path, None)
    one_pass.pack_landing(spark, path)
    _one_pass(spark, _records(second), path, None)
    fields = [*EVENT_FIELDS, "year", "month", "day", "hour"]
    return _plain(landing.read_accepted(spark, path), *fields)


@_query
def lake_compacted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of every hour after two streams and a pack."""
    pin_utc(spark)
    path, _ = _landing_and_parts(spark)
    for half in _halves(_stream(spark, folder)):
        _one_pass(spark, _records(half), path, None)
    one_pass.pack_landing(spark, path)
    return files_by_partition(spark, path, landing.LANDING_SCHEMA, landing.PARTITIONS).drop("accepted")


@_query
def stream_late_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the events come after the tables are built, a month late: their dates are built again."""
    pin_utc(spark)
    _, parts_path = _landing_and_parts(spark)
    tables_path = shared_dir(spark, "tables")
    for half in _halves(_stream(spark, folder)):
        _one_pass(spark, _records(half), None, parts_path)
        parts.refresh_tables(spark, parts_path, tables_path)
    return _plain(read_parquet(spark, f"{tables_path}/{METRIC_TABLES['5min']}"), *METRIC_FIELDS)


def _streamed_table(spark: SparkSession, folder: str, granularity: str) -> DataFrame:
    pin_utc(spark)
    _, parts_path = _landing_and_parts(spark)
    for half in _halves(_stream(spark, folder)):
        _one_pass(spark, _records(half), None, parts_path)
    parts.pack_parts(spark, parts_path)
    return _plain(parts.tables_of_parts(spark, parts_path)[METRIC_TABLES[granularity]], *METRIC_FIELDS)


@_query
def stream_event_metrics_1hr(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly metrics with exact users from the packed parts of two streams."""
    return _streamed_table(spark, folder, "1hr")


@_query
def stream_event_metrics_1day(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed_table(spark, folder, "1day")
