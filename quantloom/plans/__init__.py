"""Plans: the queries by name."""

from __future__ import annotations


def all_queries() -> dict:
    from quantloom.plans import exports, inference, learning, quantification, reads, records, relations, statistics

    found: dict = {}
    for module in (records, statistics, relations, reads, inference, quantification, learning, exports):
        found |= module.QUERIES
    return found
