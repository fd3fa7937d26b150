"""Steps over DataFrames with a context of services, and an event bus that never lets a handler break a run."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from stratalens.errors import PipelineError


@dataclass(frozen=True)
class Event:
    step: str


@dataclass(frozen=True)
class StepStarted(Event): ...


@dataclass(frozen=True)
class StepProgress(Event):
    done: int = 0


@dataclass(frozen=True)
class StepCompleted(Event):
    seconds: float = 0.0


@dataclass(frozen=True)
class StepIssue(Event):
    path: str = ""
    message: str = ""


@dataclass(frozen=True)
class FileMoved(Event):
    source: str = ""
    destination: str = ""


@dataclass(frozen=True)
class DuplicateFound(Event):
    group_number: int = 0
    n_files: int = 0


class EventBus:
    """Handlers of an event's own type come first, then those for all; their errors are kept, not raised."""

    def __init__(self) -> None:
        self._handlers: dict[type | None, list[Callable[[Event], None]]] = defaultdict(list)
        self.errors: list[tuple[Event, Exception]] = []

    def subscribe(self, handler: Callable[[Event], None], kind: type[Event] | None = None) -> Callable[[], None]:
        self._handlers[kind].append(handler)
        return lambda: self._handlers[kind].remove(handler)

    def publish(self, event: Event) -> None:
        for handler in [*self._handlers[type(event)], *self._handlers[None]]:
            try:
                handler(event)
            except Exception as error:  # noqa: BLE001
                self.errors.append((event, error))


@dataclass
class Context:
    spark: SparkSession
    config: dict[str, Any] = field(default_factory=dict)
    services: dict[str, Any] = field(default_factory=dict)
    bus: EventBus = field(default_factory=EventBus)

    def require(self, name: str) -> Any:
        if name not in self.services:
            raise PipelineError(f"the pipeline has no service {name!r}")
        return self.services[name]


Step = Callable[[dict[str, DataFrame], Context], dict[str, DataFrame]]


def run(steps: dict[str, Step], tables: dict[str, DataFrame], context: Context) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Run the steps in order, each adding or replacing named tables; (tables, seconds per step)."""
    took: dict[str, float] = {}
    for name, step in steps.items():
        context.bus.publish(StepStarted(name))
        start = time.monotonic()
        tables = tables | step(tables, context)
        took[name] = time.monotonic() - start
        context.bus.publish(StepCompleted(name, took[name]))
    return tables, took


def discovery(tables: dict[str, DataFrame], context: Context) -> dict[str, DataFrame]:
    """listing -> files and issues, by the configured filters; tells the progress at every hundredth file and the last one."""
    from stratalens.operators.inventory import discover, progress

    c = context.config
    files, issues = discover(tables["listing"], c.get("paths", {}).get("exclude_patterns"), c.get("organize", {}).get("max_depth"), c.get("symlink_policy", "skip"))
    for row in issues.toLocalIterator():
        context.bus.publish(StepIssue("discovery", row["rel"], row["message"]))
    for row in progress(files).orderBy("accepted").toLocalIterator():
        context.bus.publish(StepProgress("discovery", row["accepted"]))
    return {"files": files, "issues": issues}
