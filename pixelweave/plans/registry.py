"""All checked queries; importing a query module registers its entries."""

from __future__ import annotations

from pixelweave.plans import analysis_queries, file_queries, neighbourhood_queries, pixel_queries, temporal_queries, track_queries  # noqa: F401
from pixelweave.plans.catalog import MODULE_OF, ORACLES, QUERIES  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
