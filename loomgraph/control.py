"""Control of calls to services with quotas: budgets of fixed windows, keys in turn, pauses after errors.

A budget is a number of calls or tokens per window. A meter keeps all budgets of one key and tells when a call fits. A caller tries a
call under its pause rule and goes on to the next key when a final budget is used up. Budgets hold for a service, so a step
of several tasks gives each its share (:func:`shared`).
"""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from loomgraph.functions.textops import DAILY_QUOTA, RETRY_DELAY

# What error messages of rate limits and of passing network faults contain.
RATE_LIMIT = ("429", "RESOURCE_EXHAUSTED")
NETWORK = ("timed out", "Timeout", "ConnectionError", "ConnectionReset")


class QuotaSpent(Exception):
    """No key has anything left that waiting could bring back soon."""


@dataclass(frozen=True)
class Budget:
    """So many ``unit`` ('calls' or 'tokens') per window of ``seconds``; ``final``: nobody waits for its next window."""

    unit: str
    limit: float
    seconds: float
    final: bool = False


# What the embedding service allows one key.
EMBEDDING = (Budget("calls", 100, 60), Budget("tokens", 30_000, 60), Budget("calls", 1_000, 86_400, final=True))


def shared(budgets: Iterable[Budget], tasks: int) -> tuple[Budget, ...]:
    """The budgets of one of so many tasks that call at the same time."""
    return tuple(replace(b, limit=b.limit / tasks) for b in budgets)


class Meter:
    """What the current windows of some budgets have seen; a window opens anew once its time is over."""

    def __init__(self, budgets: Iterable[Budget], clock: Callable[[], float] = time.time) -> None:
        self.clock = clock
        self.windows = {b: (clock(), 0.0) for b in budgets}

    def wait_for(self, tokens: float) -> float:
        """Seconds until a call of so many tokens fits every budget. Raises where it never does, or not before a final budget renews."""
        now, wait = self.clock(), 0.0
        for budget, (opened, used) in self.windows.items():
            cost = 1 if budget.unit == "calls" else tokens
            if cost > budget.limit:
                raise ValueError(f"one call needs {cost:g} {budget.unit}, a window has {budget.limit:g}")
            left = opened + budget.seconds - now
            if left > 0 and used + cost > budget.limit:
                if budget.final:
                    raise QuotaSpent(f"{budget.limit:g} {budget.unit} are used up")
                wait = max(wait, left)
        return wait

    def charge(self, tokens: float) -> None:
        """Counts a call that was answered."""
        now = self.clock()
        for budget, (opened, used) in self.windows.items():
            if now >= opened + budget.seconds:
                opened, used = now, 0.0
            self.windows[budget] = (opened, used + (1 if budget.unit == "calls" else tokens))


@dataclass(frozen=True)
class Pauses:
    """How often and how long to pause after failed calls.

    A rate limit pauses for what its message asks plus ``margin``, else ``unasked`` seconds, ``growing`` with the number of the try if set;
    network faults pause only if ``network`` is set. Everything else, and a daily quota, is not tried again.
    """

    tries: int
    unasked: float = 30.0
    margin: float = 3.0
    growing: bool = False
    network: float | None = None

    def after(self, error: Exception, tried: int) -> float | None:
        text = str(error)
        if tried >= self.tries or is_daily(error):
            return None
        grown = tried + 1 if self.growing else 1
        if any(x in text for x in RATE_LIMIT):
            asked = re.search(RETRY_DELAY, text)
            return float(asked[1]) + self.margin if asked else self.unasked * grown
        return self.network * grown if self.network is not None and any(x in text for x in NETWORK) else None


#: One structured model call; a batch of embeddings; a whole question.
MODEL, EMBED, QUESTION = Pauses(3), Pauses(5), Pauses(4, 20.0, growing=True, network=10.0)


def is_daily(error: Exception) -> bool:
    """Whether an error says that the quota of a day is used up."""
    text = str(error)
    return any(x in text for x in RATE_LIMIT) and re.search(DAILY_QUOTA, text) is not None


class Caller:
    """Calls with one key after the other, each with its own meter; a key is never gone back to."""

    def __init__(self, keys: Sequence[str] = ("",), budgets: Sequence[Budget] = (), pauses: Pauses = MODEL, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        if not keys:
            raise ValueError("no key given")
        self.pauses, self.sleep = pauses, sleep
        self._lanes: Iterator[tuple[str, Meter]] = ((k, Meter(budgets, clock)) for k in keys)
        self.key, self.meter = next(self._lanes)

    def _next_key(self, reason: Exception) -> None:
        lane = next(self._lanes, None)
        if lane is None:
            raise QuotaSpent("all keys are used up") from reason
        self.key, self.meter = lane

    def __call__(self, call: Callable[[str], Any], tokens: float = 0) -> Any:
        """``call(key)`` as soon as the budgets allow, again after pauses, with the next key after a daily quota."""
        tried = itertools.count()
        while True:
            try:
                wait = self.meter.wait_for(tokens)
            except QuotaSpent as e:
                self._next_key(e)
                continue
            if wait > 0:
                self.sleep(wait)
                continue
            try:
                out = call(self.key)
            except Exception as e:  # noqa: BLE001 any error of a service
                if is_daily(e):
                    self._next_key(e)
                    continue
                pause = self.pauses.after(e, next(tried))
                if pause is None:
                    raise
                self.sleep(pause)
            else:
                self.meter.charge(tokens)
                return out
