"""Placement on a hash ring of 2**30 points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 30
FACTOR = 2654435761
#: Most nodes of a swarm, and nodes whose table is written into a plan.
MOST_NODES = 100_000
PLAN_NODES = 1024


def ring_hash(key: Column | int):
    return key.cast("long") * FACTOR % SPACE if isinstance(key, Column) else key * FACTOR % SPACE


def distance(x, y):
    return (x - y + SPACE) % SPACE


def nearest(key: int, nodes: dict[str, int], exclude: tuple[str, ...] = ()) -> str:
    """The first node clockwise from the key's hash; empty if none is left."""
    left = {n: h for n, h in nodes.items() if n not in exclude}
    return min(left, key=lambda n: distance(left[n], key), default="")


def furthest(key: int, nodes: dict[str, int], exclude: tuple[str, ...] = ()) -> str:
    left = {n: h for n, h in nodes.items() if n not in exclude}
    return max(left, key=lambda n: distance(left[n], key), default="")


def owner(h: Column, nodes: dict[str, int], far: bool = False) -> Column:
    """The nearest (furthest) node of a hash, within the scan: no join. The node is found by bisection of the sorted ring, written
    into the plan if it has at most ``PLAN_NODES`` nodes, else sent to an Arrow function. Nodes are members of a swarm, their
    number is checked."""
    if len(nodes) > MOST_NODES:
        raise ValueError("too many nodes for one swarm")
    ring = sorted((v, k) for k, v in nodes.items())
    n = len(ring)
    # nearest: the first node at or after the hash, else the ring's first; furthest: the node before that
    if n > PLAN_NODES:
        hashes, names = np.array([v for v, _ in ring]), np.array([k for _, k in ring], object)

        @F.pandas_udf("string")
        def find(x: pd.Series) -> pd.Series:
            return pd.Series(names[(np.searchsorted(hashes, x.to_numpy(), "left") - far) % n])

        return find(h)
    hashes, names = F.array(*(F.lit(v) for v, _ in ring)), F.array(*(F.lit(k) for _, k in ring))
    halves = F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length()))))
    smaller = lambda at: F.coalesce(F.get(hashes, at - 1) < h, F.lit(False))
    at = F.aggregate(halves, F.lit(0), lambda lo, half: F.when(smaller(lo + half), lo + half).otherwise(lo))
    return F.element_at(names, (F.pmod(at - F.lit(1 if far else 0), F.lit(n)) + 1).cast("int"))


def nodes_of(df: DataFrame, name: str, key: str) -> dict[str, int]:
    rows = df.select(F.col(name).alias("n"), ring_hash(F.col(key)).alias("h")).limit(MOST_NODES + 1).collect()
    return {r["n"]: r["h"] for r in rows}
