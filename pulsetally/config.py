"""Settings of the streaming jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta


@dataclass(frozen=True)
class KafkaSettings:
    """Connection, read bounds and write tuning for one Kafka topic."""

    # The defaults below.
    bootstrap_servers: str
    topic: str
    starting_offsets: str = "latest"
    # Raise (or set None for no cap) when the topic outgrows it: with a 30 s
    # trigger, 10,000 records per trigger is only ~333 records per second.
    max_offsets_per_trigger: int | None = 10_000
    min_partitions: int | None = None
    security_protocol: str = "PLAINTEXT"
    sasl_mechanism: str | None = None
    sasl_username: str | None = None
    sasl_password: str | None = field(default=None, repr=False)
    acks: str = "1"
    retries: int = 3
    compression: str = "gzip"
    batch_bytes: int = 16_384
    linger_ms: int = 10
    max_in_flight: int = 5
    request_timeout_ms: int = 30_000
    metadata_max_age_ms: int = 300_000
    # Whether a stream stops when records it has not read are gone from the topic.
    # Batch reads always stop.
    fail_on_data_loss: bool = False


@dataclass(frozen=True)
class StreamSettings:
    """Windows, watermark, trigger and the switches of the streaming jobs."""

    checkpoint_dir: str
    # The default durations.
    window: timedelta = timedelta(minutes=5)
    slide: timedelta = timedelta(minutes=1)
    user_window: timedelta = timedelta(hours=1)
    watermark: timedelta = timedelta(minutes=10)
    trigger: timedelta = timedelta(seconds=30)
    available_now: bool = False
    # Shuffle width of stateful queries. A checkpoint keeps the width it was
    # created with, so choose it for the load to come. None: the session's.
    state_partitions: int | None = None
    dedup: bool = False
    enable_lake: bool = True
    enable_metrics: bool = True

    def trigger_options(self) -> dict:
        """Keyword arguments for ``DataStreamWriter.trigger``."""
        if self.available_now:
            return {"availableNow": True}
        return {"processingTime": f"{self.trigger.total_seconds():g} seconds"}

    def checkpoint(self, name: str) -> str:
        """Checkpoint folder of one query; every query needs its own."""
        return f"{self.checkpoint_dir.rstrip('/')}/{name}"
