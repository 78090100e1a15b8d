"""All queries of the core library and the SQL that gives the same rows."""

from __future__ import annotations

from furrow.plans import q_filters, q_images, q_metrics, q_models, q_more, q_sources  # noqa: F401
from furrow.plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "knn_report"
