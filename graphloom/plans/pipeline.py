"""Named steps over DataFrames: checked once, planned lazily, run by Spark."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

Step = Callable[..., DataFrame]


@dataclass
class Pipeline:
    """steps: name -> (function, names of what it takes)."""

    steps: dict[str, tuple[Step, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, step: Step, *needs: str) -> "Pipeline":
        if name in self.steps:
            raise ValueError(f"two steps are named {name}")
        self.steps[name] = (step, needs)
        return self

    def order(self, inputs: set[str] = frozenset()) -> list[str]:
        unknown = {n for _, needs in self.steps.values() for n in needs} - set(self.steps) - set(inputs)
        if unknown:
            raise ValueError(f"nothing provides {sorted(unknown)}")
        try:
            ready = TopologicalSorter({k: set(needs) - set(inputs) for k, (_, needs) in self.steps.items()}).static_order()
            return list(ready)
        except CycleError as e:
            raise ValueError(f"steps need each other: {e.args[1]}") from e

    def plans(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        """Every step's DataFrame. Nothing runs until one of them is used."""
        made = dict(inputs)
        for name in self.order(set(inputs)):
            step, needs = self.steps[name]
            made[name] = step(*(made[n] for n in needs))
        return {k: made[k] for k in self.steps}


@dataclass(frozen=True)
class Retry:
    """How often a step is tried again and how long is waited before: fixed, linear or
    exponential. Spark itself runs lost tasks again; this is for what a driver calls."""

    most: int = 3
    strategy: str = "exponential"
    first_delay: float = 1.0
    factor: float = 2.0
    longest: float = 60.0

    def delay(self, attempt: int) -> float:
        wait = {"linear": self.first_delay * attempt, "exponential": self.first_delay * self.factor ** (attempt - 1), "fixed": self.first_delay}[self.strategy]
        return min(wait, self.longest)


#: What is done about an error of each severity.
ACTIONS = {"low": "retry", "medium": "retry_with_backoff", "high": "skip_step", "critical": "stop"}


def severity(error: BaseException) -> str:
    if isinstance(error, (MemoryError, KeyboardInterrupt, SystemExit)):
        return "critical"
    if isinstance(error, (TimeoutError, ConnectionError, InterruptedError)):
        return "medium"
    return "high" if isinstance(error, (ValueError, TypeError, KeyError, PermissionError)) else "low"


def attempted(call: Callable, policy: Retry = Retry(), *, sleep: Callable[[float], None] = time.sleep):
    """What call() returns; errors that may pass are waited out as the policy says."""
    for attempt in range(1, policy.most + 2):
        try:
            return call()
        except Exception as e:
            if attempt > policy.most or ACTIONS[severity(e)] not in ("retry", "retry_with_backoff"):
                raise
            sleep(policy.delay(attempt))
