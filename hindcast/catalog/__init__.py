"""The registered queries with their SQL counterparts."""

from __future__ import annotations


def load():
    """Import every query module and return (queries, oracle SQL)."""
    from hindcast.catalog import registry
    from hindcast.catalog import (  # noqa: F401  (registration happens on import)
        ingest,
        evaluation,
        snapshots,
        features,
        boundaries,
        roundtrips,
        streams,
        similarity,
        runs,
    )

    return registry.callables(), dict(registry.ORACLE)
