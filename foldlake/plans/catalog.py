"""Registered queries over the folder table and their SQL."""

from __future__ import annotations

from foldlake.plans import content, exchange, folder, network, pages, peers, storage, trees  # noqa: F401  fills the registry
from foldlake.plans.relations import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
