"""Barrier rules, as functions of progress: in Python on small tables, and as DataFrame filters on large ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Progress:
    worker: str
    step: int
    busy: bool = False


def _next(step: int, ps: list[Progress]) -> int:
    """The next step if all have finished this one. The books keep every step that a worker has finished, so one that is
    further has finished this one too; else a rule that lets workers ahead would never move on."""
    return step + 1 if sum(p.step >= step for p in ps) == len(ps) else step


def bsp(step: int, ps: Iterable[Progress]) -> tuple[int, list[str]]:
    """All have finished this step: the next step for all; else nobody goes."""
    ps = list(ps)
    t = _next(step, ps)
    return (t, [p.worker for p in ps]) if t > step else (step, [])


def ssp(step: int, ps: Iterable[Progress], stale: float = 1) -> tuple[int, list[str]]:
    """Idle workers fewer than ``stale`` steps ahead go on."""
    ps = list(ps)
    t = _next(step, ps)
    return t, [p.worker for p in ps if not p.busy and p.step - t < stale]


def asp(step: int, ps: Iterable[Progress]) -> tuple[int, list[str]]:
    """Every idle worker goes on."""
    return ssp(step, ps, float("inf"))


def psp(step: int, ps: Iterable[Progress], sample: int, stale: int = 1, seed: int = 0) -> tuple[int, list[str]]:
    """An extra: each idle worker looks at a random sample of others only, and goes unless one of them is ``stale`` behind."""
    ps = list(ps)
    t, r, out = _next(step, ps), np.random.default_rng([seed, step]), []
    for p in ps:
        seen = r.choice(len(ps), min(sample, len(ps)), replace=False)
        if not p.busy and all(p.step - ps[i].step < stale for i in seen):
            out.append(p.worker)
    return t, out


def p2p_bsp(own: int, peers: Iterable[int], blocked: bool) -> bool:
    """The client waits and every known peer is as far."""
    return blocked and all(s >= own for s in peers)


def p2p_asp() -> bool:
    return True


def p2p_asp_local(blocked: bool) -> bool:
    return blocked


def admitted(progress: DataFrame, rule: str, step: int | DataFrame, stale: float = 1) -> DataFrame:
    """The same over rows (worker, step, busy): (worker, t) of those that may go, t being the step after the rule.

    ``step`` is the server's current one, a number or a table of one row. How many have finished it is a one-row aggregate,
    broadcast; workers are not shuffled.
    """
    now = progress.sparkSession.range(1).select(F.lit(step).cast("long").alias("now")) if isinstance(step, int) else step.toDF("now")
    rows = progress.join(F.broadcast(now))
    whole = rows.agg(F.first("now").alias("now"), F.count(F.when(F.col("step") >= F.col("now"), 1)).alias("done"), F.count(F.lit(1)).alias("all"))
    t = F.when(F.col("done") == F.col("all"), F.col("now") + 1).otherwise(F.col("now"))
    rows = progress.join(F.broadcast(whole.select("now", t.alias("t"))))
    if rule == "bsp":
        ok = F.col("t") > F.col("now")
    else:
        ok = F.col("busy") == 0
        if rule == "ssp":
            ok = ok & (F.col("step") - F.col("t") < stale)
    return rows.filter(ok).select("worker", "t")


def p2p_admitted(peers: DataFrame, rule: str) -> DataFrame:
    """Peers (peer, step, blocked) whose barrier lets them on: those that wait and see nobody behind (bsp), that wait (asp_local), all (asp)."""
    if rule == "asp":
        return peers.select("peer")
    if rule == "asp_local":
        return peers.filter("blocked").select("peer")
    low = peers.agg(F.min("step").alias("low"))
    return peers.filter("blocked").join(F.broadcast(low)).filter("step <= low").select("peer")
