"""All queries and their SQL."""

from __future__ import annotations

from glossaflow.plans import (
    job_queries,
    stream_queries,
    structure_queries,
    term_queries,
    text_queries,
)

_MODULES = (text_queries, structure_queries, term_queries, job_queries, stream_queries)


def all_queries() -> dict:
    return {name: pair[0] for m in _MODULES for name, pair in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: pair[1] for m in _MODULES for name, pair in m.QUERIES.items() if pair[1]}
