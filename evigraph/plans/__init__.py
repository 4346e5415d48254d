"""Queries on the driver's tables."""

from evigraph.plans import ablations, analysis, caches, curation, edges, factorised, live, nodes, paths, segments, stage, web
from evigraph.plans.catalog import QUERIES as CATALOG_QUERIES
from evigraph.plans.catalog import SQL as CATALOG_SQL

__all__ = ["CATALOG_QUERIES", "CATALOG_SQL", "ablations", "analysis", "caches", "curation", "edges", "factorised", "live", "nodes", "paths", "segments", "stage", "web"]
