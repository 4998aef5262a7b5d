"""SQL with the same results as the queries, for DuckDB over the same tables."""

from __future__ import annotations

from pulsetally.plans.queries import AS_OF, DAY, VARIANTS, WEEK
from pulsetally.schema import EVENT_TYPES, PLATFORMS, USER_COUNTERS

FIELDS = (
    'event_id, event_type, user_id, content_id, platform, "timestamp", '
    "session_id, device_type, location"
)
CALENDAR = (
    'CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month, '
    'CAST(day("timestamp") AS INTEGER) AS day, CAST(hour("timestamp") AS INTEGER) AS hour'
)


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _events(map_types: bool = True) -> str:
    mapped = (
        "CASE event_type WHEN 'signup' THEN 'like' WHEN 'purchase' THEN 'share' "
        "WHEN 'error' THEN 'comment' ELSE event_type END"
    )
    return f"""
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           {mapped if map_types else "event_type"} AS event_type,
           'user_' || CAST(user_id AS VARCHAR) AS user_id,
           'content_' || CAST(event_id % 1000 AS VARCHAR) AS content_id,
           CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' WHEN 2 THEN 'android'
                ELSE 'mobile_web' END AS platform,
           ts AS "timestamp",
           'sess_' || CAST(user_id AS VARCHAR) || '_' || CAST(day(ts) AS VARCHAR) AS session_id,
           'dev_' || CAST(event_id % 7 AS VARCHAR) AS device_type,
           CASE WHEN event_id % 10 <> 0 THEN 'loc_' || CAST(event_id % 9 AS VARCHAR) END AS location,
           json_extract_string(props, '$.k') AS metadata_k,
           event_id // 100 AS batch_id,
           event_id AS "offset"
    FROM events"""


def _with(body: str, map_types: bool = True) -> str:
    return f"WITH e AS ({_events(map_types)})\n{body}"


VALID = f"event_type IN {_in(EVENT_TYPES)} AND platform IN {_in(PLATFORMS)}"


def _event_metrics(width: str, slide: str | None = None, users: str = "count(DISTINCT user_id)") -> str:
    """Event metrics; `slide` is one minute where given."""
    if slide is None:
        start, source = f"time_bucket(INTERVAL '{width}', \"timestamp\")", "e"
    else:
        start = "time_bucket(INTERVAL '1 minute', \"timestamp\") - to_minutes(CAST(k AS BIGINT))"
        source = "e, range(5) t(k)"
    return f"""
    SELECT window_start, window_start + INTERVAL '{width}' AS window_end, event_type, platform,
           count(*) AS event_count, {users} AS unique_users
    FROM (SELECT {start} AS window_start, event_type, platform, user_id FROM {source})
    GROUP BY window_start, event_type, platform"""


def _user_metrics(as_coded: bool = False) -> str:
    counters = ", ".join(
        f"count(*) AS {name}" if as_coded else f"count(*) FILTER (event_type = '{kind}') AS {name}"
        for name, kind in USER_COUNTERS.items()
    )
    return f"""
    SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, user_id, platform,
           count(*) AS total_events, {counters}
    FROM (SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS window_start, user_id, platform,
                 event_type FROM e)
    GROUP BY window_start, user_id, platform"""


SLIDING = _event_metrics("5 minutes", "1 minute")
TUMBLING = _event_metrics("5 minutes")
HOURLY = _event_metrics("1 hour")
DAILY = _event_metrics("1 day")


def _recent(hours: int) -> str:
    return f"window_start >= TIMESTAMP '{AS_OF}' - INTERVAL '{hours} hours'"


def _event_report(table: str, hours: int, limit: int, more: str = "") -> str:
    return _with(f"""
    SELECT * FROM ({table}) WHERE {_recent(hours)} {more}
    ORDER BY window_start DESC, event_type, platform LIMIT {limit}""")


def _user_report(hours: int, limit: int, more: str = "") -> str:
    return _with(f"""
    SELECT * FROM ({_user_metrics()}) WHERE {_recent(hours)} {more}
    ORDER BY total_events DESC, window_start DESC, user_id, platform LIMIT {limit}""")


ALIGNED = "AND epoch_us(window_start) % 300000000 = 0"


def _distribution(more: str = "") -> str:
    """Shares in whole hundredths of a percent, rounded half to even by integers."""
    return _with(f"""
    SELECT event_type, total_count,
           CAST(q + CASE WHEN 2 * r > total OR (2 * r = total AND q % 2 = 1) THEN 1 ELSE 0 END
                AS DOUBLE) / 100 AS percentage
    FROM (SELECT *, total_count * 10000 // total AS q, total_count * 10000 % total AS r
          FROM (SELECT *, CAST(sum(total_count) OVER () AS BIGINT) AS total
                FROM (SELECT event_type, CAST(sum(event_count) AS BIGINT) AS total_count
                      FROM ({SLIDING}) WHERE {_recent(WEEK)} {more} GROUP BY event_type)))""")


def _platforms(more: str = "") -> str:
    return _with(f"""
    SELECT platform, CAST(sum(event_count) AS BIGINT) AS total_events,
           CAST(sum(unique_users) AS BIGINT) AS unique_users
    FROM ({SLIDING}) WHERE {_recent(WEEK)} {more} GROUP BY platform""")


PLATFORM_USERS = _with(f"""
    SELECT platform, count(*) AS total_events, count(DISTINCT user_id) AS unique_users
    FROM e WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL '{WEEK} hours' GROUP BY platform""")

# At sizes where the sketches are exact the estimate is the count.
PLATFORM_ESTIMATES = f"""
    SELECT *, abs(unique_users - exact_users) * 100 <= exact_users * 5 AS within_5_percent
    FROM (SELECT *, unique_users AS exact_users FROM ({PLATFORM_USERS}))"""


def _closed(table: str, columns: str = "*") -> str:
    """Windows a stream has emitted when it has read everything."""
    return _with(f"""
    SELECT {columns} FROM ({table})
    WHERE window_end <= (SELECT date_trunc('milliseconds', max("timestamp")) FROM e)
                        - INTERVAL '10 minutes'""")


def _sessions(having: str = "") -> str:
    """The first event of every session of a user; a session ends with six hours of silence."""
    order = 'PARTITION BY user_id ORDER BY "timestamp"'
    return _with(f"""
    SELECT 'id-' || user_id AS event_id, min("timestamp") AS "timestamp",
           arg_min(content_id, "timestamp") AS content_id
    FROM (SELECT *, sum(CASE WHEN "timestamp" - before < INTERVAL '6 hours' THEN 0 ELSE 1 END) OVER ({order}) AS session
          FROM (SELECT *, lag("timestamp") OVER ({order}) AS before FROM e))
    GROUP BY user_id, session {having}""")


def _outcome(rows: str) -> str:
    return f"""
    SELECT batch_id, total_events, total_events - failed AS successful, failed,
           CASE WHEN failed = 0 THEN 'success' WHEN failed = total_events THEN 'error'
                ELSE 'partial' END AS status,
           CASE WHEN failed = 0 THEN ''
                ELSE CAST(failed AS VARCHAR) || ' events failed to publish.' END AS errors
    FROM (SELECT batch_id, count(*) AS total_events, count(*) FILTER (NOT ok) AS failed
          FROM ({rows}) GROUP BY batch_id)"""


ISO = (
    "CASE WHEN epoch_us(\"timestamp\") % 1000000 = 0 "
    "THEN strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f') END"
)

# The printed size of {"text": ...}: compact JSON, one space after the colon,
# and a double quote inside the text counts once.
PRINTED = """length(CAST(json_object('text', text) AS VARCHAR)) + 1
           - (length(text) - length(replace(text, '"', '')))"""

TURNS = f"""
    SELECT conv_id AS batch_id, turn, role, text,
           length(role) BETWEEN 1 AND 100 AND trim(role) <> '' AND {PRINTED} <= 1000 AS ok
    FROM conversations"""

DECODED = _with(f"SELECT {FIELDS}, metadata_k FROM e")


def _with_totals(report: str, value: str, hours: int) -> str:
    return f"""
    SELECT *, count(*) OVER () AS total_records, CAST(sum({value}) OVER () AS BIGINT) AS grand_total,
           'Last {hours} hours' AS time_range
    FROM ({report}) AS report"""


def _pipeline() -> str:
    """Landed records and all tables of the valid ones, in common columns."""
    tables = {"event_metrics_5min": SLIDING, "event_metrics_1hr": HOURLY, "event_metrics_1day": DAILY}
    metric_rows = " UNION ALL ".join(
        f"SELECT '{name}', window_start, event_type, platform, event_count, unique_users FROM ({sql})"
        for name, sql in tables.items()
    )
    return f"""WITH given AS ({_events(False)}), e AS (SELECT * FROM given WHERE {VALID})
    SELECT 'accepted' AS source, "timestamp" AS window_start, event_id AS name, platform,
           CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m FROM e
    UNION ALL
    SELECT 'rejected', NULL, event_id, 'event_type_unknown', 1, 0 FROM given WHERE NOT ({VALID})
    UNION ALL {metric_rows}
    UNION ALL
    SELECT 'user_metrics_1hr', window_start, user_id, platform, total_events, views FROM ({_user_metrics()})"""


def all_sql() -> dict[str, str]:
    """Query name -> SQL; reports over stored tables are the direct ones with their totals."""
    direct = _direct_sql()
    stored = {
        "report_event_metrics": ("event_count", DAY),
        "report_user_metrics": ("total_events", DAY),
        "report_top_users": ("total_events", WEEK),
        "report_event_distribution": ("total_count", WEEK),
        "report_platform_metrics": ("total_events", WEEK),
        "report_platform_metrics_sketch": ("total_events", WEEK),
    }
    plain = direct | {"report_platform_metrics_sketch": PLATFORM_USERS}
    return direct | {f"{n}_stored": _with_totals(plain[n], *options) for n, options in stored.items()}


def _direct_sql() -> dict[str, str]:
    sliding = _with(SLIDING)
    hourly, daily = _with(HOURLY), _with(DAILY)
    fields = _with(f"SELECT {FIELDS} FROM e")
    return {
        "decode_events": DECODED,
        "publish_payload": _with(f"""
    SELECT user_id AS key, event_id, event_type, user_id, content_id, platform,
           {ISO} AS "timestamp", session_id, device_type, location, metadata_k FROM e"""),
        "validate_valid": _with(f"SELECT {FIELDS}, metadata_k FROM e WHERE {VALID}", False),
        "validate_rejects": _with(
            f"SELECT event_id, event_type, 'event_type_unknown' AS reasons FROM e WHERE NOT ({VALID})",
            False,
        ),
        "validate_raw_texts": "SELECT doc_id, 'payload_malformed' AS reasons FROM documents",
        "validate_documents": f"""
    SELECT doc_id, source AS user_id, concat_ws(',',
             CASE WHEN lang NOT IN {_in(PLATFORMS)} THEN 'platform_unknown' END,
             CASE WHEN length(text) > 100 THEN 'content_id_too_long' END,
             CASE WHEN length(source) > 50 THEN 'device_type_too_long' END,
             CASE WHEN length(text) > 100 THEN 'location_too_long' END,
             CASE WHEN {PRINTED} > 1000 THEN 'metadata_too_large' END) AS reasons
    FROM documents""",
        "default_event_id": """
    SELECT event_id AS "offset", sha256('events|0|' || CAST(event_id AS VARCHAR)) AS event_id,
           ts AS "timestamp", CAST(0 AS INTEGER) AS metadata_size FROM events""",
        "batch_outcome": _with(_outcome(f"SELECT batch_id, ({VALID}) AS ok FROM e"), False),
        "batch_outcome_conversations": _outcome(TURNS),
        "batch_atomic": f"""
    SELECT batch_id, turn, role AS user_id, text
    FROM (SELECT *, bool_and(ok) OVER (PARTITION BY batch_id) AS whole,
                 count(*) OVER (PARTITION BY batch_id) AS size FROM ({TURNS}))
    WHERE whole AND size BETWEEN 1 AND 1000""",
        "batch_size_limit": """
    SELECT batch_id, count(*) AS total_events, count(*) BETWEEN 1 AND 1000 AS size_ok
    FROM (SELECT 'supplier-' || CAST(l_suppkey AS VARCHAR) AS batch_id FROM lineitem
          UNION ALL SELECT 'quantity-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem)
    GROUP BY batch_id""",
        "lake_partition_columns": _with(f"SELECT event_id, {CALENDAR} FROM e"),
        "lake_roundtrip": _with(f"""
    SELECT {FIELDS}, metadata_k, CAST(year("timestamp") AS INTEGER) AS year,
           CAST(hour("timestamp") AS INTEGER) AS hour FROM e"""),
        "lake_roundtrip_pruned": _with(f"""
    SELECT {FIELDS} FROM e WHERE "timestamp" >= TIMESTAMP '2024-01-09 06:30:00'
      AND "timestamp" < TIMESTAMP '2024-01-17 00:00:00'"""),
        "landing_accepted": _with(f"SELECT {FIELDS}, {CALENDAR} FROM e WHERE {VALID}", False),
        "landing_rejected": _with(
            f"SELECT event_id, 'event_type_unknown' AS reasons, {CALENDAR} FROM e WHERE NOT ({VALID})",
            False,
        ),
        "event_metrics_5min_sliding": sliding,
        "event_metrics_5min_sliding_approx": sliding,
        "event_metrics_5min_as_coded": _with(_event_metrics("5 minutes", "1 minute", "count(*)")),
        "event_metrics_5min_tumbling": _with(TUMBLING),
        "event_metrics_1hr": hourly,
        "event_metrics_1day": daily,
        "rollup_5min": sliding,
        "rollup_1hr": hourly,
        "rollup_1day": daily,
        "user_metrics_1hr": _with(_user_metrics()),
        "user_metrics_1hr_as_coded": _with(_user_metrics(as_coded=True)),
        "events_per_user": _with("SELECT user_id, count(*) AS event_count FROM e GROUP BY user_id"),
        "events_per_window_type": _with("""
    SELECT window_start, window_start + INTERVAL '5 minutes' AS window_end, event_type,
           count(*) AS event_count
    FROM (SELECT time_bucket(INTERVAL '5 minutes', "timestamp") AS window_start, event_type FROM e)
    GROUP BY window_start, event_type"""),
        "filter_by_type": _with(f"SELECT {FIELDS} FROM e WHERE event_type = 'like'"),
        "report_event_metrics": _event_report(SLIDING, DAY, 100),
        "report_event_metrics_1hr": _event_report(HOURLY, WEEK, 1000),
        "report_event_metrics_1day": _event_report(DAILY, WEEK, 100),
        "report_event_metrics_filtered": _event_report(
            SLIDING, WEEK, 1000, "AND event_type = 'like' AND platform = 'web'"
        ),
        "report_user_metrics": _user_report(DAY, 100),
        "report_user_metrics_filtered": _user_report(
            WEEK, 1000, "AND user_id = 'user_7' AND platform = 'ios'"
        ),
        "report_top_users": _with(f"""
    SELECT *, CAST(row_number() OVER (ORDER BY total_events DESC, user_id, platform) AS INTEGER) AS rank
    FROM (SELECT user_id, platform, CAST(sum(total_events) AS BIGINT) AS total_events
          FROM ({_user_metrics()}) WHERE {_recent(WEEK)} GROUP BY user_id, platform
          ORDER BY total_events DESC, user_id, platform LIMIT 100)"""),
        "report_event_distribution": _distribution(),
        "report_event_distribution_tumbling": _distribution(ALIGNED),
        "report_platform_metrics": _platforms(),
        "report_platform_metrics_tumbling": _platforms(ALIGNED),
        "report_platform_metrics_exact": PLATFORM_USERS,
        "report_platform_metrics_sketch": PLATFORM_ESTIMATES,
        "report_user_metrics_lookup": _user_report(WEEK, 1000, "AND user_id = 'user_7' AND platform = 'ios'"),
        "top_users_rolling": _with("""
    SELECT day, user_id, platform, total_events, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total_events DESC, user_id, platform) AS rank
          FROM (SELECT d.day, user_id, platform, count(*) AS total_events
                FROM e JOIN (SELECT DISTINCT CAST("timestamp" AS DATE) AS day FROM e) d
                  ON CAST("timestamp" AS DATE) BETWEEN d.day - 6 AND d.day
                GROUP BY d.day, user_id, platform))
    WHERE rank <= 10"""),
        "validate_variants": f"""
    SELECT event_id AS "offset", [{", ".join(f"'{reasons}'" for reasons, _ in VARIANTS)}][event_id % {len(VARIANTS)} + 1] AS reasons
    FROM events""",
        "idempotent_replay": hourly,
        "newest_batch_per_key": daily,
        "batch_outcome_sizes": """
    WITH r AS (
        SELECT 'supplier-' || CAST(l_suppkey AS VARCHAR) AS batch_id, l_linenumber < 7 AS ok FROM lineitem
        UNION ALL
        SELECT 'quantity-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), l_linenumber < 7 FROM lineitem
    ), c AS (
        SELECT batch_id, count(*) AS total_events,
               CASE WHEN count(*) > 1000 THEN 0 ELSE count(*) FILTER (ok) END AS successful
        FROM r GROUP BY batch_id
    )
    SELECT batch_id, total_events, successful, total_events - successful AS failed,
           CASE WHEN successful = total_events THEN 'success' WHEN successful = 0 THEN 'error'
                ELSE 'partial' END AS status,
           CASE WHEN successful = total_events THEN ''
                ELSE CAST(total_events - successful AS VARCHAR) || ' events failed to publish.' END AS errors
    FROM c""",
        "dedup_batch_differing": _with("""
    SELECT 'id-' || user_id AS event_id, min("timestamp") AS "timestamp" FROM e GROUP BY user_id"""),
        "replay_after_new_checkpoint": daily,
        "compaction_in_steps": daily,
        "compaction_other_dates": daily,
        "append_after_build": daily,
        "stream_after_build": _with(f"""
    SELECT * FROM ({_user_metrics()})
    WHERE window_start < (SELECT date_trunc('hour', max("timestamp")) - INTERVAL '1 hour' FROM e)"""),
        "failed_batch_replayed": daily,
        "stream_pipeline": _pipeline(),
        "stream_outcomes": _with(_outcome(f"SELECT CAST(batch_id AS VARCHAR) AS batch_id, ({VALID}) AS ok FROM e"), False),
        "stream_reasons": _with(f"""
    SELECT CASE WHEN {VALID} THEN '' ELSE 'event_type_unknown' END AS reason, count(*) AS records
    FROM e GROUP BY 1""", False),
        "dedup_sessions": _sessions(),
        "stream_dedup_sessions": _sessions("""
    HAVING max("timestamp") + INTERVAL '6 hours'
           <= (SELECT date_trunc('milliseconds', max("timestamp")) FROM e) - INTERVAL '10 minutes'"""),
        "stream_open_windows": _with(f"""
    SELECT * FROM ({_user_metrics()})
    WHERE window_end > (SELECT date_trunc('milliseconds', max("timestamp")) FROM e)
                       - INTERVAL '10 minutes'"""),
        "lake_compacted": _with(f"SELECT {FIELDS}, {CALENDAR} FROM e"),
        "lake_compacted_files": _with(f"""
    SELECT year, month, day, hour, CAST(1 AS BIGINT) AS files
    FROM (SELECT DISTINCT {CALENDAR} FROM e)"""),
        "stream_late_corrected": sliding,
        "stream_event_metrics_1hr": hourly,
        "stream_event_metrics_1day": daily,
        "lake_stream_and_backfill": _with(f"SELECT {FIELDS}, {CALENDAR} FROM e"),
        "landing_stream_and_backfill": _with(
            f"SELECT event_id, CASE WHEN {VALID} THEN '' ELSE 'event_type_unknown' END AS reasons FROM e",
            False,
        ),
        "landing_restored": _with("SELECT event_id, event_type, user_id, platform FROM e", False),
        "tables_after_stream": _closed(_user_metrics()),
        "stream_event_metrics_5min": _closed(SLIDING),
        "stream_event_metrics_5min_exact": _closed(SLIDING),
        "stream_user_metrics_1hr": _closed(_user_metrics()),
        "dedup_batch": fields,
        "stream_dedup": fields,
        "stream_lake": _with(f"SELECT {FIELDS}, {CALENDAR} FROM e"),
        "stream_landing": _with(f"""
    SELECT event_type, CASE WHEN {VALID} THEN '' ELSE 'event_type_unknown' END AS reasons,
           count(*) AS records FROM e GROUP BY 1, 2""", False),
    }
