"""Settings of a run, with their defaults. Secrets never show in ``repr``."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class BufferConfig:
    jobs: int | None = None  # None: as many as there are cores
    sources_channel_size: int = 100

    def parallelism(self, cores: int) -> int:
        return max(1, self.jobs if self.jobs is not None else cores)


@dataclass(frozen=True)
class SinkConfig:
    """A partitioned log: topics, retries, and how accounts are committed."""

    brokers: str = ""
    transaction_topic: str = "transaction.slots"
    account_topic: str = "account.slots"
    fallback_topic: str | None = None
    message_timeout_ms: int = 5_000
    transaction_timeout_ms: int = 30_000
    write_attempts: int = 3
    write_backoff_ms: int = 200
    compression: str = "lz4"
    transactional_id: str | None = None
    #: finalized_passthrough writes at once; processed commits whole slots at ``commit_at``.
    account_mode: str = "finalized_passthrough"
    commit_at: str = "confirmed"
    password: str | None = field(default=None, repr=False)

    def options(self) -> dict[str, str]:
        """For ``DataFrameWriter.options`` of a log's connector."""
        out = {"kafka.bootstrap.servers": self.brokers, "kafka.compression.type": self.compression, "kafka.enable.idempotence": "true", "kafka.delivery.timeout.ms": str(self.message_timeout_ms)}
        if self.transactional_id:
            out |= {"kafka.transactional.id": self.transactional_id, "kafka.transaction.timeout.ms": str(self.transaction_timeout_ms)}
        return out


@dataclass(frozen=True)
class SourceConfig:
    endpoint: str = ""
    commitment: str = "confirmed"
    from_slot: int | None = None
    max_retries: int = 10
    first_pause_ms: int = 500
    last_pause_ms: int = 10_000
    compression: str | None = None
    token: str | None = field(default=None, repr=False)


@dataclass(frozen=True)
class RunConfig:
    buffer: BufferConfig = BufferConfig()
    sink: SinkConfig = SinkConfig()
    source: SourceConfig = SourceConfig()


def load(text: str) -> RunConfig:
    """From TOML; dashes and underscores are alike, unknown names are refused."""
    doc = tomllib.loads(text)
    parts = {"buffer": BufferConfig, "sink": SinkConfig, "source": SourceConfig}
    if unknown := set(doc) - set(parts):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    made = {}
    for name, kind in parts.items():
        given = {k.replace("-", "_"): v for k, v in doc.get(name, {}).items()}
        if unknown := set(given) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown settings of {name}: {sorted(unknown)}")
        made[name] = kind(**given)
    return RunConfig(**made)
