"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from slotweave.plans import decoding, programs, sources, streams, transactions  # noqa: F401  (they register their queries)

QUERIES, ORACLE_SQL = transactions.QUERIES, transactions.ORACLE_SQL
