"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from loomgraph.plans import base, generated, history, search, structure, words  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
