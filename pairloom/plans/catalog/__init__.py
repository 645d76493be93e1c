"""All registered queries."""

from pairloom.plans.catalog import (  # noqa: F401  (importing registers the queries)
    classification,
    curation,
    ingest,
    metrics,
    prosody,
    ranking,
    runlogs,
    scores,
    text,
)
from pairloom.plans.catalog.registry import CATALOG, Query

__all__ = ["CATALOG", "Query"]
