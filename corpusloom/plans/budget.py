"""Budgets of pages and the search for what fits."""

from __future__ import annotations

import os
from collections.abc import Callable

from corpusloom.errors import ConfigError

DEFAULT = 8_500
GLOBAL = "CORPUSLOOM_BUDGET"


class BudgetTooSmall(ConfigError):
    """A piece that a page can't do without costs more than its budget."""

    def __init__(self, tool: str, budget: int, piece: str):
        super().__init__(f"the budget of {tool} is {budget} tokens, too few for {piece}; raise {GLOBAL}_{tool.upper()}")


def resolve(tool: str, env: dict[str, str] | None = None) -> int:
    """A tool's own budget, else the one for all, else DEFAULT; the former may not exceed the latter."""
    env = os.environ if env is None else env
    found = []
    for key in (GLOBAL, f"{GLOBAL}_{tool.upper()}"):
        value = env.get(key)
        if value is not None and (not value.strip().isdigit() or int(value) < 1):
            raise ConfigError(f"{key} must be a positive number")
        found.append(None if value is None else int(value))
    both, own = found
    if own and both and own > both:
        raise ConfigError(f"{GLOBAL}_{tool.upper()} exceeds {GLOBAL}")
    return own or both or DEFAULT


def largest_fitting(most: int, fits: Callable[[int], bool]) -> int:
    """The largest k in 1..most that fits, looked for at most first and then by halving 1..most-1; 0 if none does."""
    if most and fits(most):
        return most
    low, high, best = 1, most - 1, 0
    while low <= high:
        mid = (low + high) // 2
        if fits(mid):
            best, low = mid, mid + 1
        else:
            high = mid - 1
    return best


def page_rows(head_limit: int, budget: int) -> int:
    """Rows that a search page may take: the limit (0: none), but never more than the budget can show."""
    ceiling = max(1, 4 * budget + 1)
    return min(head_limit, ceiling) if head_limit else ceiling
