"""All registered queries, loaded in one place."""

from rungwork.plans import (  # noqa: F401
    queries_calibration,
    queries_files,
    queries_frontier,
    queries_streaming,
    queries_text,
    queries_training,
    queries_variants,
)
from rungwork.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
