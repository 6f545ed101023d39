"""All registered queries."""

from pagelake.plans import catalog_files, catalog_flows, catalog_metrics, catalog_models, catalog_pages, catalog_store  # noqa: F401
from pagelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
