"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from stratascope.plans import calibration_queries, discovery_queries, event_queries, field_queries, interval_queries, motif_queries, null_queries, plane_queries, power_queries, record_queries, search_queries, source_queries, transform_queries

MODULES = (event_queries, interval_queries, field_queries, record_queries, source_queries, null_queries, search_queries, plane_queries, discovery_queries, motif_queries, transform_queries, power_queries, calibration_queries)


def _joined(parts: list[dict]) -> dict:
    """The parts as one; a name that stands in two of them is refused."""
    out: dict = {}
    for part in parts:
        if both := sorted(out.keys() & part.keys()):
            raise ValueError(f"registered twice: {', '.join(both)}")
        out |= part
    return out


def queries() -> dict[str, Callable]:
    return _joined([m.queries.queries for m in MODULES])


def oracle_sql() -> dict[str, str]:
    return _joined([m.queries.sql for m in MODULES])
