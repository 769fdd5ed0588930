"""Plans on streams: only operators that look at one row at a time run on a stream as they are."""

from __future__ import annotations

from ..plans.tables import CONTENT_EXTRACT, FEATURE_TRANSFORM, FILTER, PROJECT, SCAN
from ..plans.tree import PlanNode

STATELESS = frozenset({SCAN, FILTER, PROJECT, FEATURE_TRANSFORM, CONTENT_EXTRACT})


def streamable(plan: PlanNode) -> bool:
    """Whether the compiled plan may be started as a stream with the append mode."""
    return all(op in STATELESS for op in plan.ops())
