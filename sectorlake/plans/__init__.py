"""Query plans over the driver's tables; each names the operator of the inventory it exercises."""

from __future__ import annotations


def load_reference_queries() -> tuple[dict, dict]:
    """``(queries, oracles)`` of every plan module."""
    from sectorlake.plans import images, positions, recordings, registry, reports, signals, streams, timeline  # noqa: F401  they register themselves

    return registry.QUERIES, registry.ORACLES
