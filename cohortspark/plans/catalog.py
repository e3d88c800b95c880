"""All named queries."""

from __future__ import annotations

from cohortspark.plans import cohort_queries, evaluation_queries, series_queries, voxel_queries  # noqa: F401
from cohortspark.plans.registry import REGISTRY, Query


def catalog() -> dict[str, Query]:
    return dict(REGISTRY)
