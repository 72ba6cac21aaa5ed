"""The output that calls of one turn share."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

#: Tokens of a turn's pool, the least that a call is given, and the pause that ends a turn, in seconds.
POOL, FLOOR, GAP = 9_000, 128, 1.0
# fixed values: hard limits of a turn, by a part of the host's name in any case
HOST_CAPS = {"codex": 13_599}
STUBS = ("(Output of this turn is used up; call again in a new turn with the same arguments.)", "(Output used up.)", "")


@dataclass
class Pool:
    """Thread-safe claims on a turn's tokens: begin() each call, claim() once its size is known, complete() it."""

    clock: Callable[[], float]
    pool: int = POOL
    cap: int | None = None
    generation: int = 0
    active: int = 0
    unclaimed: int = 0
    spent: int = 0
    reserved: int = 0
    completed: float | None = None
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def begin(self) -> Call:
        """A call; it opens a new turn if none is active and the last one ended GAP ago."""
        with self.lock:
            if not self.active and (self.completed is None or self.clock() - self.completed >= GAP):
                self.generation += 1
                self.spent = self.reserved = self.unclaimed = 0
            self.active += 1
            self.unclaimed += 1
            return Call(self, self.generation)


@dataclass
class Call:
    turns: Pool
    generation: int
    granted: int | None = None
    #: Whether less than FLOOR was left when the call claimed: it may only say so.
    exhausted: bool = False
    done: bool = False

    def claim(self, hint: int) -> int:
        """Tokens that the call may return: its fair share of what is left, at least FLOOR, within the hard limit."""
        p = self.turns
        with p.lock:
            if self.generation != p.generation:
                self.granted = min(hint, FLOOR)
                self.exhausted = True
                return self.granted
            used = p.spent + p.reserved
            left = max(0, p.pool - used)
            share = max(left // max(1, p.unclaimed), FLOOR)
            hard = max(0, p.cap - used) if p.cap is not None else share
            self.granted = min(hint, share, hard)
            self.exhausted = left < FLOOR or p.cap is not None and hard < FLOOR
            p.unclaimed = max(0, p.unclaimed - 1)
            p.reserved += self.granted
            return self.granted

    def complete(self, actual: int = 0) -> None:
        """Give back what was granted and charge what was returned; once."""
        p = self.turns
        with p.lock:
            if self.done:
                return
            self.done = True
            if self.generation == p.generation:
                if self.granted is None:
                    p.unclaimed = max(0, p.unclaimed - 1)
                else:
                    p.reserved -= self.granted
                p.spent += actual
            p.active -= 1
            p.completed = p.clock()

    def __enter__(self) -> Call:
        return self

    def __exit__(self, *_) -> None:
        self.complete(0)


def for_host(name: str, clock: Callable[[], float]) -> Pool:
    """A pool with the limits of a host."""
    return Pool(clock, cap=next((n for k, n in HOST_CAPS.items() if k in name.lower()), None))


def stub(allowed: int, cost: Callable[[str], int]) -> str:
    """The longest message that fits."""
    return next((s for s in STUBS if cost(s) <= allowed), "")
