"""How many rows to materialize.

exact: the join's own size (or a given one). public: a size released before; then nothing about the exact size is told.
simulation: sized from the sensitivity, for benchmarks; not a private release. Spark hides no access patterns, whatever the policy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .contributions import count_output
from .sensitivity import padded_size
from .tree import JoinTree, OutputTooLarge

MAX_ROWS = 200_000_000  #: rows materialized at most, unless said otherwise
POLICIES = ("exact", "public", "simulation")


@dataclass
class Target:
    rows: int
    policy: str
    exact_is_public: bool


def select_target(tree: JoinTree, policy: str = "exact", explicit: int = 0, epsilon: float = 1.0, delta: float = 1e-9, max_rows: int = MAX_ROWS) -> Target:
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    if policy == "public":
        if explicit <= 0:
            raise ValueError("a public target is a positive size released before")
        rows = explicit
    elif policy == "simulation":
        if explicit or not (math.isfinite(epsilon) and math.isfinite(delta) and epsilon > 0 and 0 < delta < 1):
            raise ValueError("a simulated target has a positive epsilon, a delta between 0 and 1, and no explicit size")
        size = padded_size(tree, epsilon, delta)
        if not size.sensitivity:
            raise ValueError("the sensitivity takes too long to compute for this epsilon and number of relations")
        rows = size.target
    else:
        if explicit < 0:
            raise ValueError("a size is not negative")
        rows = explicit or max(1, count_output(tree))
    if rows > max_rows:  # the exact size never takes the place of a target that is too large
        raise OutputTooLarge(rows, max_rows)
    return Target(rows, policy, policy == "exact")


def may_copy_out(target: Target) -> bool:
    """Under a public target the rows and their validity stay inside."""
    return target.policy != "public"
