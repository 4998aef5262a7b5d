"""Kafka topic as a stream or, between offsets, as a batch.

Needs Spark's Kafka connector on the class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsetally.config import KafkaSettings


def connection_options(kafka: KafkaSettings) -> dict[str, str]:
    """Options which reader and writer share: brokers and, if secured, credentials."""
    options = {"kafka.bootstrap.servers": kafka.bootstrap_servers}
    if kafka.security_protocol != "PLAINTEXT":
        options["kafka.security.protocol"] = kafka.security_protocol
        if kafka.sasl_mechanism:
            options["kafka.sasl.mechanism"] = kafka.sasl_mechanism
            options["kafka.sasl.jaas.config"] = _login(kafka)
    return options


def _login(kafka: KafkaSettings) -> str:
    module = "scram.ScramLoginModule" if "SCRAM" in kafka.sasl_mechanism else "plain.PlainLoginModule"
    user, password = (_quoted(v or "") for v in (kafka.sasl_username, kafka.sasl_password))
    return (
        f"org.apache.kafka.common.security.{module} required "
        f"username={user} password={password};"
    )


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{escaped}"'


def stream_options(kafka: KafkaSettings) -> dict[str, str]:
    options = connection_options(kafka) | {
        "subscribe": kafka.topic,
        "startingOffsets": kafka.starting_offsets,
        "failOnDataLoss": str(kafka.fail_on_data_loss).lower(),
    }
    if kafka.max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(kafka.max_offsets_per_trigger)
    # Splits a topic partition over several tasks, for hot partitions.
    if kafka.min_partitions:
        options["minPartitions"] = str(kafka.min_partitions)
    return options


def read_stream(spark: SparkSession, kafka: KafkaSettings) -> DataFrame:
    """Records key, value, topic, partition, offset, timestamp as a stream."""
    return spark.readStream.format("kafka").options(**stream_options(kafka)).load()


def read_batch(
    spark: SparkSession, kafka: KafkaSettings, starting: str = "earliest", ending: str = "latest"
) -> DataFrame:
    """The records between two offsets, for backfills."""
    options = connection_options(kafka) | {
        "subscribe": kafka.topic,
        "startingOffsets": starting,
        "endingOffsets": ending,
        "failOnDataLoss": "true",
    }
    if kafka.min_partitions:
        options["minPartitions"] = str(kafka.min_partitions)
    return spark.read.format("kafka").options(**options).load()
