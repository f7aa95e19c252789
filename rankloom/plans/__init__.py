"""Query catalogue."""

from __future__ import annotations


def load_catalogue() -> tuple[dict, dict]:
    """All named core queries and their SQL."""
    from rankloom.plans import catalogue, cleaning, exports, records, retrieval, scoring, streams, texts  # noqa: F401

    return catalogue.QUERIES, catalogue.ORACLES
