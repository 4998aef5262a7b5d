"""Publish events to a Kafka topic. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsetally.config import KafkaSettings, StreamSettings
from pulsetally.operators.decode import encode_events
from pulsetally.sources.kafka import connection_options
from pulsetally.streaming.start import start_query

# Fixed value: the producer's largest request.
MAX_REQUEST = 1_048_576


def writer_options(kafka: KafkaSettings) -> dict[str, str]:
    """Connection and producer tuning of the writer."""
    return connection_options(kafka) | {
        "topic": kafka.topic,
        "kafka.acks": kafka.acks,
        "kafka.retries": str(kafka.retries),
        "kafka.compression.type": kafka.compression,
        "kafka.batch.size": str(kafka.batch_bytes),
        "kafka.linger.ms": str(kafka.linger_ms),
        "kafka.max.in.flight.requests.per.connection": str(kafka.max_in_flight),
        "kafka.request.timeout.ms": str(kafka.request_timeout_ms),
        "kafka.metadata.max.age.ms": str(kafka.metadata_max_age_ms),
    }


def observed(rows: DataFrame, ok: Column, name: str = "publish") -> tuple[DataFrame, Observation]:
    """Count good and bad rows while they are written, without a second pass."""
    good = F.coalesce(ok, F.lit(False))
    observation = Observation(name)
    counted = rows.observe(
        observation,
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
    )
    return counted, observation


def sendable() -> Column:
    """Whether a record can be sent: it has a payload the producer takes as one request."""
    return F.octet_length("value") <= MAX_REQUEST


def publish(events: DataFrame, kafka: KafkaSettings) -> tuple[int, int]:
    """Publish a batch; how many records went out and how many could not. A broken connection raises."""
    records, counts = observed(encode_events(events), sendable())
    records.where(sendable()).write.format("kafka").options(**writer_options(kafka)).save()
    return counts.get["successful"], counts.get["failed"]


def publish_stream(
    events: DataFrame, kafka: KafkaSettings, settings: StreamSettings, name: str = "publish"
) -> StreamingQuery:
    """Publish a stream of events."""
    records = encode_events(events)
    writer = records.writeStream.format("kafka").options(**writer_options(kafka))
    return start_query(records, writer, settings, name)
