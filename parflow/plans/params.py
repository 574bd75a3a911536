"""A versioned key-value model store, and the parameter server's and the peers' loops as Spark supersteps.

The store is a DataFrame (k, v, t). Each round the barrier admits workers, ``schedule`` gives them tasks on the store as it then
is, ``push`` runs over all tasks in one job, and what workers hand in goes through ``pull`` into the store. A worker may take
several rounds over a task (``finishes``): its updates are kept, and it is busy, until it hands in. So one worker can really be
ahead of another, as far as the barrier lets it. Rounds are sequential, so a run is one valid schedule, and it can be repeated.

Tables that live from round to round are settled: written to the shared folder, or, if they have few rows, kept as rows of the
plan. The plan of a round is therefore as long in round 10,000 as in the first.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parflow.sources.io import discard, materialise

from . import barriers
from .ring import SPACE, owner, ring_hash

BARRIERS = {"bsp": barriers.bsp, "ssp": barriers.ssp, "asp": barriers.asp, "psp": lambda s, p: barriers.psp(s, p, sample=2)}
#: A settled table with at most so many rows and bytes is kept as rows of the plan.
FEW_ROWS, FEW_BYTES = 4096, 16_000_000


class Table:
    """A settled table. Its old files go as soon as it is settled anew. ``small`` is false where rows are known to be too many for
    the plan; then they are not counted, which would compute them twice. ``own``: ``df`` is a table made by :func:`materialise`."""

    def __init__(self, df: DataFrame, small: bool = True, own: bool = False) -> None:
        self.df, self._own, self._small = df, own, small

    @property
    def small(self) -> bool:
        return self._small

    def settle(self, df: DataFrame) -> DataFrame:
        """Make ``df``, which may read this table, its new content."""
        old, owned = self.df, self._own
        if self._small:
            rows = df.limit(FEW_ROWS + 1).toArrow()
            self._small = rows.num_rows <= FEW_ROWS and rows.nbytes <= FEW_BYTES
        if self._small:
            self.df, self._own = df.sparkSession.createDataFrame(rows.combine_chunks(), df.schema), False
        else:
            self.df, self._own = materialise(df, "store"), True
        if owned:
            discard(old)
        return self.df


class Store:
    """Last write wins, by order of arrival, whatever its step."""

    def __init__(self, df: DataFrame, small: bool = True, own: bool = False) -> None:
        self._table = Table(df, small, own)

    @property
    def small(self) -> bool:
        return self._table.small

    @property
    def df(self) -> DataFrame:
        return self._table.df

    @classmethod
    def empty(cls, spark: SparkSession, schema: str = "k long, v double, t long") -> Store:
        return cls(spark.createDataFrame([], schema))

    def get(self, k: Any) -> tuple[Any, int]:
        rows = self.df.filter(F.col("k") == k).take(1)
        if not rows:
            raise KeyError(k)
        return rows[0]["v"], rows[0]["t"]

    def set(self, k: Any, v: Any, t: int = 0) -> None:
        self.upsert(self.df.sparkSession.createDataFrame([(k, v, t)], self.df.schema))

    def keys(self) -> DataFrame:
        return self.df.select("k")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Replace or add rows (k, v, t). Of several for one key the last by ``order`` counts; without it the one of the latest
        step, of equals the greatest value. The rows are evaluated once: both sides are one aggregate over their union."""
        rows = last_write(rows, order) if order is not None else rows
        sides = self.df.select("k", "v", "t", F.lit(0).alias("new")).unionByName(rows.select("k", "v", "t", F.lit(1).alias("new")))
        newest = F.max_by(F.struct("v", "t"), F.struct("new", "t", "v"))
        self._table.settle(sides.groupBy("k").agg(newest.alias("x")).select("k", "x.v", "x.t"))


def last_write(rows: DataFrame, order: str) -> DataFrame:
    """(k, v, t): of each key the value that arrived last; t is that arrival's. Combines before the shuffle."""
    return rows.groupBy("k").agg(F.max_by("v", order).alias("v"), F.max(order).alias("t"))


def subtract(updates: DataFrame, store: DataFrame) -> DataFrame:
    """v - sum of updates per key, with the latest step: the accumulating merge."""
    d = updates.groupBy("k").agg(F.sum("v").alias("d"), F.max("t").alias("t1"))
    return store.join(d, "k").select("k", (F.col("v") - F.col("d")).alias("v"), F.greatest("t", "t1").alias("t"))


def subtract_last(updates: DataFrame, store: DataFrame) -> DataFrame:
    """v - the last update of each key: updates of one batch do not add up, the last wins."""
    d = updates.groupBy("k").agg(F.max_by("v", F.struct("t", "v")).alias("d"), F.max("t").alias("t1"))
    return store.join(d, "k").select("k", (F.col("v") - F.col("d")).alias("v"), F.greatest("t", "t1").alias("t"))


def subtract_vectors(updates: DataFrame, store: DataFrame, last: bool = False) -> DataFrame:
    """:func:`subtract` and :func:`subtract_last` for arrays: element by element. A key's updates are summed by position."""
    if last:
        d = updates.groupBy("k").agg(F.max_by("v", F.struct("t", "v")).alias("d"), F.max("t").alias("t1"))
    else:
        parts = updates.select("k", "t", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"), F.max("t").alias("t1"))
        d = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("d"), F.max("t1").alias("t1"))
    return store.join(d, "k").select("k", F.zip_with("v", "d", lambda a, b: a - b).alias("v"), F.greatest("t", "t1").alias("t"))


def _kind(store: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in store.schema if f.name != "t")


class ParamServer:
    """``schedule(workers, store) -> tasks (worker, k, v, ...)``; ``push``: pandas frame of one worker's tasks -> frame (k, v);
    ``pull(updates (k, v, t), store) -> rows (k, v, t)``; ``barrier(step, progress) -> (step, workers)``; ``stop(server) -> bool``.

    ``finishes(worker, round) -> bool`` says whether a busy worker hands in at the end of a round; by default it does.
    """

    def __init__(self, store: Store, workers: list[str], barrier: str | Callable = "bsp", finishes: Callable[[str, int], bool] = lambda worker, n: True) -> None:
        self.store, self.names, self.step, self.rounds = store, workers, 0, 0
        self.progress = {w: 0 for w in workers}
        self.busy = {w: False for w in workers}
        self._finishes = finishes
        self.register_barrier(BARRIERS[barrier] if isinstance(barrier, str) else barrier)
        self.register_schedule(lambda workers, store: None)
        self.register_push(lambda frame: frame[["k", "v"]])
        self.register_pull(lambda updates, store: last_write(updates, "t"))
        self.register_stop(lambda server: False)

    def register_barrier(self, f: Callable) -> None:
        self._barrier = f

    def register_schedule(self, f: Callable) -> None:
        self._schedule = f

    def register_push(self, f: Callable) -> None:
        self._push = f

    def register_pull(self, f: Callable) -> None:
        self._pull = f

    def register_stop(self, f: Callable) -> None:
        self._stop = f

    def get(self, k: Any) -> tuple[Any, int]:
        return self.store.get(k)

    def set(self, k: Any, v: Any) -> None:
        self.store.set(k, v, self.step)

    def keys(self) -> DataFrame:
        return self.store.keys()

    def worker_num(self) -> int:
        return len(self.names)

    def start(self, rounds: int | None = None) -> Store:
        spark, kind, n = self.store.df.sparkSession, _kind(self.store.df), 0
        waiting = Table(spark.createDataFrame([], f"worker string, {kind}, t long"))
        held = False
        while not self._stop(self) and (rounds is None or n < rounds):
            n += 1
            self.rounds += 1
            self.step, go = self._barrier(self.step, [barriers.Progress(w, s, self.busy[w]) for w, s in self.progress.items()])
            go = [w for w in go if not self.busy[w]]
            tasks = self._schedule(go, self.store.df) if go else None
            self.busy.update(dict.fromkeys(go, True))
            done = [w for w in self.names if self.busy[w] and self._finishes(w, self.rounds)]
            updates = self._updates(tasks, go, kind) if tasks is not None else None
            if held or updates is not None and set(go) - set(done):
                table = waiting.df if updates is None else waiting.df.unionByName(updates)
                updates = waiting.settle(table)
                held = set(done) != {w for w in self.names if self.busy[w]}
            if updates is not None and done:
                of = updates.filter(F.col("worker").isin(done)).select("k", "v", "t")
                self.store.upsert(self._pull(of, self.store.df))
                if held:
                    waiting.settle(waiting.df.filter(~F.col("worker").isin(done)))
                else:
                    waiting = Table(spark.createDataFrame([], f"worker string, {kind}, t long"))
            for w in done:
                self.progress[w] += 1
                self.busy[w] = False
        return self.store

    def _updates(self, tasks: DataFrame, go: list[str], kind: str) -> DataFrame:
        """(worker, k, v, t), t being the step that the worker is on its way to."""
        push, to = self._push, {w: self.progress[w] + 1 for w in go}

        def run(key, frame):
            out = push(frame)
            out.insert(0, "worker", key[0])
            out["t"] = to[key[0]]
            return out

        return tasks.filter(F.col("worker").isin(go)).groupBy("worker").applyInPandas(run, f"worker string, {kind}, t long")


class PeerSwarm:
    """Every peer is a client and a server that holds the keys nearest to it on the ring.

    In a round, each client that acts and does not wait at its barrier fetches keys, computes, sends its updates to the owners of
    their keys, and waits; its server is then a step further, and all peers hear of it. Owners keep updates until their own barrier lets them
    in; then they go through ``pull`` into the store and the owner's client goes on. Nothing is lost where a barrier refuses.

    ``schedule(swarm, peers) -> keys (peer, k, ...)``; ``push``: frame (peer, k, v, t, ...) of one peer -> frame (k, v);
    ``pull(updates (k, v, t), store) -> rows (k, v, t)``; ``barrier(own, others, blocked) -> bool``, by default always true;
    ``stop(swarm)``. ``acts(peer, round) -> bool``: which clients act; by default all.
    """

    def __init__(self, store: Store, peers: dict[str, int], barrier: Callable | None = None, acts: Callable[[str, int], bool] = lambda peer, n: True) -> None:
        self.store, self.peers, self.rounds = store, dict(peers), 0
        self.steps = {p: 0 for p in peers}
        self.blocked = {p: False for p in peers}
        self._acts = acts
        self._buffer = Table(store.df.limit(0), store.small)
        self._compute = None
        self._buffered = False
        self.register_barrier(barrier or (lambda own, others, blocked: True))
        self.register_schedule(lambda swarm, peers: None)
        self.register_push(lambda frame: frame[["k", "v"]])
        self.register_pull(lambda updates, store: last_write(updates, "t"))
        self.register_stop(lambda swarm: False)

    register_barrier, register_schedule, register_push, register_pull, register_stop = (ParamServer.register_barrier, ParamServer.register_schedule, ParamServer.register_push, ParamServer.register_pull, ParamServer.register_stop)

    def register_compute(self, f: Callable) -> None:
        """``f(wanted, store, steps) -> updates (k, v, t)`` takes the place of fetching and ``push``, where a peer's rows are too many
        for one frame."""
        self._compute = f

    @property
    def step(self) -> int:
        return max(self.steps.values(), default=0)

    def owners(self, df: DataFrame | None = None) -> DataFrame:
        """Rows with a key, and the peer that owns it; keys that are strings are placed by a digest."""
        df = self.store.df if df is None else df
        place = F.pmod(F.xxhash64("k"), F.lit(SPACE)) if dict(df.dtypes)["k"] == "string" else ring_hash(F.col("k"))
        return df.withColumn("owner", owner(place, self.peers))

    def get(self, k: Any) -> tuple[Any, int]:
        return self.store.get(k)

    def set(self, k: Any, v: Any, client: str | None = None) -> None:
        """A server's own write shows at once; a client's is stamped with its server's step and waits for the owner's barrier."""
        if client is None:
            self.store.set(k, v, self.step)
        else:
            self._keep(self.store.df.sparkSession.createDataFrame([(k, v, self.steps[client])], self.store.df.schema))

    def _keep(self, rows: DataFrame) -> None:
        self._buffer.settle(self._buffer.df.unionByName(rows.select("k", "v", "t")))
        self._buffered = True

    def swarm_size(self) -> int:
        return len(self.peers)

    @staticmethod
    def is_server() -> bool:
        """The driver serves; tasks are clients."""
        return TaskContext.get() is None

    def join(self, name: str, h: int) -> None:
        """A new peer takes the keys nearest to it: owners are computed from the ring, so nothing is copied."""
        self.peers[name], self.steps[name], self.blocked[name] = h, self.step, False

    def start(self, rounds: int | None = None) -> Store:
        n = 0
        while not self._stop(self) and (rounds is None or n < rounds):
            n += 1
            self.rounds += 1
            go = [p for p in self.peers if not self.blocked[p] and self._acts(p, self.rounds)]
            wanted = self._schedule(self, go) if go else None
            if wanted is not None:
                self._keep(self._updates(wanted, go))
            for p in go:
                self.steps[p] += 1
                self.blocked[p] = True
            past = [p for p, s in self.steps.items() if self._barrier(s, [x for q, x in self.steps.items() if q != p], self.blocked[p])]
            if past and self._buffered:
                self._deliver(past)
            self.blocked.update(dict.fromkeys(past, False))
        return self.store

    def _updates(self, wanted: DataFrame, go: list[str]) -> DataFrame:
        push, at = self._push, {p: self.steps[p] for p in go}
        if self._compute:
            return self._compute(wanted.filter(F.col("peer").isin(go)), self.store.df, at)

        def run(key, frame):
            out = push(frame)
            out["t"] = at[key[0]]
            return out

        return wanted.filter(F.col("peer").isin(go)).join(self.store.df, "k").groupBy("peer").applyInPandas(run, f"{_kind(self.store.df)}, t long")

    def _deliver(self, past: list[str]) -> None:
        every = len(past) == len(self.peers)
        rows = self._buffer.df if every else self.owners(self._buffer.df).filter(F.col("owner").isin(past)).drop("owner")
        self.store.upsert(self._pull(rows, self.store.df))
        left = self._buffer.df.limit(0) if every else self.owners(self._buffer.df).filter(~F.col("owner").isin(past)).drop("owner")
        self._buffer.settle(left)
        self._buffered = not every
