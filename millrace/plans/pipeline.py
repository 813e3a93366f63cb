"""Several contracts in order of what they depend on, by layer and in waves."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from .contract import Contract

LAYERS = ("bronze", "silver", "gold")


class Cycle(ValueError):
    """Contracts depend on each other in a circle."""


def waves(depends: dict[str, Iterable[str]]) -> list[list[str]]:
    """Names in waves: each depends only on earlier waves.  Unknown names are outside and count as done."""
    left = {n: {d for d in ds if d in depends} for n, ds in depends.items()}
    out = []
    while left:
        ready = sorted(n for n, ds in left.items() if not ds)
        if not ready:
            raise Cycle(f"in a circle: {', '.join(sorted(left))}")
        out.append(ready)
        left = {n: ds - set(ready) for n, ds in left.items() if n not in ready}
    return out


def downstream(depends: dict[str, Iterable[str]], changed: Iterable[str]) -> list[str]:
    """All that must be built again after a change, in order."""
    hit = set(changed)
    order = [n for w in waves(depends) for n in w]
    for n in order:
        if hit & set(depends[n]):
            hit.add(n)
    return [n for n in order if n in hit]


@dataclass
class Outcome:
    name: str
    status: str
    attempts: int = 0
    seconds: float = 0.0
    counts: dict[str, Any] = field(default_factory=dict)
    error: str | None = None


@dataclass
class Options:
    threads: int = 4
    retries: int = 0
    wait_s: float = 1.0
    #: failures after which nothing more is started
    breaker: int | None = None
    stop_on_failure: bool = True
    resume_from: dict[str, str] = field(default_factory=dict)


class Pipeline:
    """``step(contract) -> counts`` for every contract; one that failed skips what depends on it."""

    def __init__(self, contracts: list[Contract], step: Callable[[Contract], dict[str, Any]], options: Options = Options()):
        self.contracts = {c.name: c for c in contracts}
        self.step, self.options = step, options

    def order(self, layer: str | None = None) -> list[list[str]]:
        chosen = {n: c.depends_on for n, c in self.contracts.items() if layer is None or c.layer == layer}
        return waves(chosen)

    def run(self) -> dict[str, Outcome]:
        done: dict[str, Outcome] = {}
        layers = [x for x in LAYERS if any(c.layer == x for c in self.contracts.values())]
        groups = [self.order(x) for x in layers]
        groups.append(waves({n: c.depends_on for n, c in self.contracts.items() if c.layer not in LAYERS}))
        failures = 0
        for group in groups:
            for wave in group:
                go = []
                for n in wave:
                    if self.options.resume_from.get(n) == "success":
                        done[n] = Outcome(n, "resumed")
                    elif any(done.get(d) and done[d].status in ("failed", "skipped") for d in self.contracts[n].depends_on) and self.options.stop_on_failure:
                        done[n] = Outcome(n, "skipped", error="upstream failed")
                    elif self.options.breaker is not None and failures >= self.options.breaker:
                        done[n] = Outcome(n, "skipped", error="circuit breaker")
                    else:
                        go.append(n)
                with ThreadPoolExecutor(max(1, min(self.options.threads, len(go)))) as pool:
                    for o in pool.map(self._one, go):
                        done[o.name] = o
                        failures += o.status == "failed"
        return done

    def _one(self, name: str) -> Outcome:
        began, error = time.time(), None
        for attempt in range(1, self.options.retries + 2):
            try:
                counts = self.step(self.contracts[name])
                return Outcome(name, "success", attempt, time.time() - began, counts or {})
            except Exception as e:  # noqa: BLE001 - a step may fail in any way
                error = f"{type(e).__name__}: {e}"[:500]
                if attempt <= self.options.retries:
                    time.sleep(self.options.wait_s * 2 ** (attempt - 1))
        return Outcome(name, "failed", self.options.retries + 1, time.time() - began, {}, error)


def upstream_fresh(runs, dataset: str, now, window_hours: float, grace_hours: float = 0.0, policy: str = "strict") -> tuple[bool, str]:
    """May a step run, given its upstream's last success?  ``warn`` always may."""
    from pyspark.sql import functions as F

    last = runs.filter((F.col("dataset") == dataset) & (F.col("status") == "success")).agg(F.max("timestamp")).first()[0]
    if last is None:
        return policy != "strict", "no successful run"
    age = (now - last).total_seconds() / 3600
    ok = age <= window_hours + grace_hours
    return ok or policy != "strict", f"{age:.1f} h old"
