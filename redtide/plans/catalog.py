"""All registered queries; importing the modules fills the registry."""

from redtide.plans import (  # noqa: F401
    queries_blocking,
    queries_clean,
    queries_composite,
    queries_matchup,
    queries_metrics,
    queries_models,
    queries_ocean,
    queries_sources,
)
from redtide.plans.registry import ORACLES, QUERIES  # noqa: F401
