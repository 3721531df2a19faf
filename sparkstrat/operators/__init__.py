"""The operator vocabulary: every token, what kind of builder it has, and the builder."""

from __future__ import annotations

from .decisions import FOLDED, ORDERED, ROW
from .folds import FOLDS
from .panel import PANEL
from .scalar import SCALAR
from .series import FRAMES, SERIES
from .weights import WEIGHTS

#: Tokens that describe a record or are reserved: they have a name and a type, and nothing to run.
METADATA_ONLY = [
    "core.plan.noop", "core.plan.order_intent", "core.optimizer.mean_variance", "core.event.join_asof", "core.event.filter", "core.event.window_count", "core.distribution.normal_fit",
    "core.distribution.quantile", "core.distribution.tail_probability", "core.execution.submit_order", "core.execution.cancel_order", "core.execution.fill_report", "core.score.calibrate",
]

REGISTRY: dict[str, tuple[str, object]] = {}
for _kind, _table in (("row", SCALAR), ("row", ROW), ("ordered", SERIES), ("ordered", ORDERED), ("frame", FRAMES), ("fold", FOLDS), ("panel", PANEL), ("weights", WEIGHTS), ("group", FOLDED)):
    REGISTRY |= {token: (_kind, builder) for token, builder in _table.items()}
REGISTRY |= {token: ("metadata", None) for token in METADATA_ONLY}


def canonical(token: str) -> str:
    """``math.add`` or ``core.math.add``, with or without a version after ``@``."""
    name = token.split("@")[0]
    return name if name.startswith("core.") else f"core.{name}"
