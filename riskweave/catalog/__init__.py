"""Registered queries on the driver's tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from riskweave.catalog import (  # noqa: F401  (importing a module registers its queries)
    drift_queries,
    feature_queries,
    io_queries,
    metric_queries,
    model_queries,
    policy_queries,
    reconcile_queries,
    request_queries,
    resample_queries,
    split_queries,
    stream_queries,
)
from riskweave.catalog.common import QUERIES, SQL  # noqa: F401
