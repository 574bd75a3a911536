"""The programs that come with the engine: word count, k-means, gradient descent, topic model, distributed arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parflow.algos import gibbs
from parflow.functions.scalars import STOP_WORDS, ascii_lower, byte_length, split, squared_distance
from parflow.operators.dataset import Dataset
from parflow.plans import barriers
from parflow.plans.params import ParamServer, PeerSwarm, Store, last_write, subtract_vectors
from parflow.plans.ring import ring_hash
from parflow.sources.io import discard, materialise


def word_count(lines: Dataset, text: str = "value") -> DataFrame:
    """(w, n): words between blanks, tabs and line ends, in ASCII lower case, without stop words."""
    words = lines.flatmap(split(F.col(text)), "w").map(ascii_lower("w").alias("w"))
    return words.filter((byte_length("w") > 0) & ~F.col("w").isin(*STOP_WORDS)).reduce_by_key(F.count(F.lit(1)).alias("n"), key="w").df


def nearest_centre(point: list[Column], centres: list[tuple[int, list[float]]]) -> Column:
    """Number of the nearest centre; of equals the lowest. Inside the scan: no join, no shuffle."""
    return F.array_min(F.array(*(F.struct(squared_distance(point, [F.lit(x) for x in c]).alias("d"), F.lit(k).alias("k")) for k, c in centres)))["k"]


def k_means(points: DataFrame, columns: list[str], centres: list[tuple[float, ...]], rounds: int) -> list[tuple[int, list[float], int]]:
    """Lloyd's rounds: (k, centre, members); a centre without members disappears. Points are cached; each round shuffles one
    partial aggregate a task, and only centres come to the driver."""
    points = points.select(*columns).persist()
    now = [(k, list(map(float, c)), 0) for k, c in enumerate(centres)]
    for _ in range(rounds):
        k = nearest_centre([F.col(c) for c in columns], [(k, c) for k, c, _ in now])
        rows = points.groupBy(k.alias("k")).agg(*(F.avg(c).alias(c) for c in columns), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
        now = [(r["k"], [r[c] for c in columns], r["n"]) for r in rows]
    points.unpersist()
    return now


def descend(rows: DataFrame, xs: list[str], y: str, start: list[float], rate: float, steps: int) -> list[float]:
    """Full-batch gradient descent of a linear model under squared error; one aggregate a step."""
    w = list(start)
    rows = rows.select(*xs, y).persist()
    for _ in range(steps):
        residual = sum((F.lit(w[j]) * F.col(x) for j, x in enumerate(xs[1:], 1)), F.lit(w[0]) * F.col(xs[0])) - F.col(y)
        g = rows.agg(*(F.avg(2 * F.col(x) * residual) for x in xs)).first()
        w = [a - rate * b for a, b in zip(w, g)]
    rows.unpersist()
    return w


def drawn(share: float, seed: int, step: int, who: Column | str, row: Column | str) -> Column:
    """Whether a step's batch has a row: by a digest of all four, so a rerun draws the same."""
    key = F.concat_ws(":", F.lit(seed), F.lit(step), who, F.col(row) if isinstance(row, str) else row)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") < F.lit(int((1 << 32) * min(1.0, share)))


def sgd(rows: DataFrame, xs: list[str], ys: list[str], model: np.ndarray, rate: float, steps: int, batch: int, seed: int, row: str = "id") -> np.ndarray:
    """Minibatch descent of all columns at once: every step is one aggregate over about ``batch`` rows, drawn by ``row``."""
    rows = rows.select(row, *xs, *ys).persist()
    n = max(1, rows.count())
    m = np.array(model, float)
    for step in range(steps):
        res = [sum((F.lit(float(m[j, k])) * F.col(x) for j, x in enumerate(xs)), F.lit(0.0)) - F.col(y) for k, y in enumerate(ys)]
        got = rows.filter(drawn(batch / n, seed, step, F.lit("all"), row)).agg(*(F.coalesce(F.avg(2 * F.col(x) * r), F.lit(0.0)) for x in xs for r in res)).first()
        m = m - rate * np.array(list(got)).reshape(m.shape)
    rows.unpersist()
    return m


class _Classifiers:
    """What the parameter server and the peers share in training the columns of a linear model, one key a column."""

    def __init__(self, rows: DataFrame, xs: list[str], ys: list[str], model: np.ndarray, rate: float, batch: int, seed: int, row: str) -> None:
        self.rows = rows.select(F.col(row).alias("row"), F.array(*xs).cast("array<double>").alias("x"), F.array(*ys).cast("array<double>").alias("y")).persist()
        self.rate, self.seed, self.columns = rate, seed, len(ys)
        self.share = batch / max(1, self.rows.count())
        spark = rows.sparkSession
        self.store = Store(spark.createDataFrame([(k, [float(v) for v in np.asarray(model, float)[:, k]], 0) for k in range(len(ys))], "k int, v array<double>, t long"))

    def column(self, who: str, step: int) -> int:
        """The column that a worker takes in a step, by a digest."""
        return int(hashlib.md5(f"{self.seed}:{step}:{who}".encode()).hexdigest()[:8], 16) % self.columns

    def batches(self, workers: list[str], step: int, name: str) -> DataFrame:
        """(name, k, x, y): the rows that each worker draws, and its column. Workers are few; rows are read once for all."""
        picks = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(self.column(w, step)).alias("k")) for w in workers)))
        every = self.rows.select("row", "x", "y", picks.alias("pick"))
        return every.filter(drawn(self.share, self.seed, step, F.col("pick.w"), "row")).select(F.col("pick.w").alias(name), F.col("pick.k").alias("k"), "x", F.element_at("y", F.col("pick.k") + 1).alias("y"))

    def push(self, frame: pd.DataFrame) -> pd.DataFrame:
        x, v = np.stack(frame["x"].to_numpy()), np.asarray(frame["v"].iloc[0], float)
        g = 2 * x.T @ (x @ v - frame["y"].to_numpy()) / len(x)
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "v": [(self.rate * g).tolist()]})

    def __getstate__(self) -> dict:
        return {"rate": self.rate}  # all that tasks need

    def result(self) -> np.ndarray:
        self.rows.unpersist()
        got = {r["k"]: r["v"] for r in self.store.df.collect()}
        return np.array([got[k] for k in range(self.columns)]).T


def sgd_param(rows: DataFrame, xs: list[str], ys: list[str], model: np.ndarray, rate: float, rounds: int, batch: int, seed: int, workers: int = 2, barrier: str = "bsp", row: str = "id", finishes: Callable[[str, int], bool] = lambda worker, n: True) -> np.ndarray:
    """Descent on a parameter server: each admitted worker gets one column, draws a batch, and hands in rate times its gradient."""
    c = _Classifiers(rows, xs, ys, model, rate, batch, seed, row)
    ps = ParamServer(c.store, [f"w{i}" for i in range(workers)], barrier, finishes)
    ps.register_schedule(lambda go, store: c.batches(go, ps.rounds, "worker").join(F.broadcast(store.select("k", "v")), "k"))
    ps.register_push(c.push)
    ps.register_pull(subtract_vectors)
    ps.start(rounds)
    return c.result()


def sgd_peer(rows: DataFrame, xs: list[str], ys: list[str], model: np.ndarray, rate: float, rounds: int, batch: int, seed: int, peers: int = 2, last: bool = False, row: str = "id", acts: Callable[[str, int], bool] = lambda peer, n: True) -> np.ndarray:
    """Descent among peers that wait for the slowest: updates of one column add up, or, with ``last``, the last one counts."""
    c = _Classifiers(rows, xs, ys, model, rate, batch, seed, row)
    swarm = PeerSwarm(c.store, {f"w{i}": ring_hash(i + 1) for i in range(peers)}, barriers.p2p_bsp, acts)
    swarm.register_schedule(lambda s, go: c.batches(go, s.rounds, "peer"))
    swarm.register_push(c.push)
    swarm.register_pull(lambda updates, store: subtract_vectors(updates, store, last))
    swarm.start(rounds)
    return c.result()


def forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """What each layer of a network puts out: tanh inside, linear at the end. A layer's last row is its bias."""
    out = [x]
    for i, w in enumerate(layers):
        z = out[-1] @ w[:-1] + w[-1]
        out.append(np.tanh(z) if i + 1 < len(layers) else z)
    return out


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean squared error, by backpropagation."""
    out = forward(layers, x)
    d, g = 2 * (out[-1] - y) / len(x), []
    for i in reversed(range(len(layers))):
        g.append(np.vstack([out[i].T @ d, d.sum(0)]))
        d = (d @ layers[i][:-1].T) * (1 - out[i] ** 2) if i else d
    return g[::-1]


def train_network(rows: DataFrame, xs: list[str], ys: list[str], hidden: list[int], rate: float, rounds: int, batch: int, seed: int = 0, workers: int = 2, barrier: str = "bsp", row: str = "id") -> list[np.ndarray]:
    """A neural network trained on the parameter server, one key a layer: every worker gets all layers and a batch of its own, and
    hands in rate times the gradient of each layer, averaged over the workers."""
    sizes, r = [len(xs), *hidden, len(ys)], np.random.default_rng(seed)
    shapes = [(a + 1, b) for a, b in zip(sizes, sizes[1:])]
    data = rows.select(F.col(row).alias("row"), F.array(*xs).cast("array<double>").alias("x"), F.array(*ys).cast("array<double>").alias("y")).persist()
    share = batch / max(1, data.count())
    start = [(i, (r.normal(size=s) / np.sqrt(s[0])).ravel().tolist(), 0) for i, s in enumerate(shapes)]
    ps = ParamServer(Store(rows.sparkSession.createDataFrame(start, "k int, v array<double>, t long")), [f"w{i}" for i in range(workers)], barrier)

    def schedule(go: list[str], store: DataFrame) -> DataFrame:
        every = data.select("row", "x", "y", F.explode(F.array(*map(F.lit, go))).alias("worker")).filter(drawn(share, seed, ps.rounds, F.col("worker"), "row"))
        none = F.lit(None).cast("array<double>")
        layers = store.select(F.explode(F.array(*map(F.lit, go))).alias("worker"), "k", "v", none.alias("x"), none.alias("y"))
        return layers.unionByName(every.select("worker", F.lit(-1).alias("k"), none.alias("v"), "x", "y"))

    def push(frame: pd.DataFrame) -> pd.DataFrame:
        held, drawn_ = frame[frame.k >= 0].sort_values("k"), frame[frame.k < 0]
        layers = [np.asarray(v, float).reshape(s) for v, s in zip(held.v, shapes)]
        g = gradients(layers, np.stack(drawn_.x.to_numpy()), np.stack(drawn_.y.to_numpy())) if len(drawn_) else [np.zeros(s) for s in shapes]
        return pd.DataFrame({"k": range(len(g)), "v": [(rate / workers * a).ravel().tolist() for a in g]})

    ps.register_schedule(schedule)
    ps.register_push(push)
    ps.register_pull(subtract_vectors)
    ps.start(rounds)
    data.unpersist()
    got = {x["k"]: x["v"] for x in ps.store.df.collect()}
    return [np.array(got[i]).reshape(s) for i, s in enumerate(shapes)]


def lda_counts(tokens: DataFrame, topic: Column) -> DataFrame:
    """Word-topic counts (w, topic, n) of tokens (w)."""
    return tokens.groupBy("w", topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def lda(docs: DataFrame, topics: int, sweeps: int, seed: int = 0, alpha: float = 50.0, beta: float = 0.1) -> tuple[DataFrame, list[float]]:
    """Collapsed Gibbs sampling over documents (doc, words array<string>), counts of words in topics as of the last sweep.

    Each sweep samples all documents in parallel on the word-topic table of the sweep before (its rows go to the blocks of
    documents that hold the word; of words in the most blocks a bounded number to all), then counts anew: stale by one sweep, as in any distributed sampler.
    Returns (doc, words, topics) and the log-likelihood per token of every sweep. Null words are left out.
    """
    held, curve = lda_blocks(docs, topics, sweeps, seed, alpha, beta)
    return gibbs.each(held, gibbs.documents, "doc long, words array<string>, z array<int>"), curve


def lda_blocks(docs: DataFrame, topics: int, sweeps: int, seed: int = 0, alpha: float = 50.0, beta: float = 0.1) -> tuple[DataFrame, list[float]]:
    """:func:`lda`, its documents left in blocks."""
    with gibbs.small_batches(docs.sparkSession):
        return _lda_blocks(docs, topics, sweeps, seed, alpha, beta)


def _lda_blocks(docs: DataFrame, topics: int, sweeps: int, seed: int, alpha: float, beta: float) -> tuple[DataFrame, list[float]]:
    words = docs.select(F.col("doc").cast("long").alias("doc"), F.col("words").cast("array<string>").alias("words"))

    def begin(ids: list, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([gibbs.stream([seed], d).integers(0, topics, n) for d, n in zip(ids, sizes)]).astype(np.uint16)

    state = materialise(gibbs.blocks(words, begin), "lda")
    curve = []
    for sweep in range(sweeps):
        table = materialise(gibbs.table(state, topics), "lda")
        got = table.agg(F.count(F.lit(1)).alias("v"), *(F.coalesce(F.sum(F.col("c")[j]), F.lit(0)).alias(f"n{j}") for j in range(topics))).first()
        vocabulary, n_k = got["v"], np.array(got[1:], float)
        rows, head = gibbs.common(table, topics)
        head = docs.sparkSession.sparkContext.broadcast(head)
        gibbs.released(docs.sparkSession)

        def sample(block, part, b, rows, sweep=sweep, n_k=n_k, vocabulary=vocabulary, head=head):
            of, there = gibbs.matrix(b, [rows, head.value], topics)
            of[~there] = b.counts(topics)[~there]  # words of this block alone
            z, ll = gibbs.sample(b, of, np.ones_like(there), n_k, vocabulary, alpha, beta, lambda d: gibbs.stream([seed, sweep + 1], d))
            return pa.table({"block": [block], "part": [part], "payload": pa.array([b._replace(z=z).pack()], pa.binary()), "ll": [ll]})

        after = materialise(gibbs.with_rows(state, rows, sample, gibbs.KIND + ", ll double"), "lda")
        for old in (table, state):
            discard(old)
        head.unpersist()
        gibbs.released(docs.sparkSession)
        ll, n = after.agg(F.sum("ll")).first()[0], n_k.sum()
        curve.append(ll / n if n else 0.0)
        state = after.drop("ll")
    return state, curve


def lda_peer(docs: DataFrame, topics: int, rounds: int, peers: int = 4, share: float = 0.1, seed: int = 0, alpha: float = 50.0, beta: float = 0.1, acts: Callable[[str, int], bool] = lambda peer, n: True) -> tuple[DataFrame, Store]:
    """Gibbs sampling among peers: (doc, words, z) and the model, over documents (doc, words array<string>).

    The model has a key for each word ("w:", tokens by topic), for the totals ("n") and for each document ("d:", its tokens'
    topics). A round, each peer draws a ``share`` of the words, fetches their rows, the totals and its own documents, samples the
    tokens of those words anew, and sends differences of rows, and the documents' new topics. Peers wait for the slowest. Only a
    document's peer changes its topics, so rows always agree with them, however stale the rows were that it sampled by. A peer's
    documents are sampled in blocks, side by side: each on the rows as fetched and its own changes. Documents have different
    numbers; those without a number, and null words, are left out.
    """
    over, store = lda_peer_blocks(docs, topics, rounds, peers, share, seed, alpha, beta, acts)
    return over(gibbs.documents, "doc long, words array<string>, z array<int>"), store


def lda_peer_blocks(docs: DataFrame, topics: int, rounds: int, peers: int = 4, share: float = 0.1, seed: int = 0, alpha: float = 50.0, beta: float = 0.1, acts: Callable[[str, int], bool] = lambda peer, n: True) -> tuple[Callable[[Callable, str], DataFrame], Store]:
    """:func:`lda_peer`, but in place of the documents what runs a function (block, part, content) over their blocks."""
    with gibbs.small_batches(docs.sparkSession):
        return _lda_peer_blocks(docs, topics, rounds, peers, share, seed, alpha, beta, acts)


def _lda_peer_blocks(docs: DataFrame, topics: int, rounds: int, peers: int, share: float, seed: int, alpha: float, beta: float, acts: Callable[[str, int], bool]) -> tuple[Callable[[Callable, str], DataFrame], Store]:
    spark = docs.sparkSession
    words = docs.select(F.col("doc").cast("long").alias("doc"), F.col("words").cast("array<string>").alias("words")).filter("doc is not null")

    def begin(ids: list, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([gibbs.stream([seed], d).integers(0, topics, n) for d, n in zip(ids, sizes)]).astype(np.uint16)

    doc_keys = lambda b: pc.binary_join_element_wise("d:", b.docs.cast(pa.string()), "")
    word_keys = lambda b: pc.binary_join_element_wise("w:", b.names, "")

    def total(block: int, part: int, b: gibbs.Block) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([np.bincount(b.z, minlength=topics).astype(float)], pa.list_(pa.float64()))], names=["v"])

    def assigned(block: int, part: int, b: gibbs.Block) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([doc_keys(b), b.lists(pa.array(b.z, pa.float64()))], names=["k", "v"])

    text = materialise(gibbs.blocks(words, begin, f"pmod(doc, {peers}L)"), "lda")
    n = gibbs.each(text, total, "v array<double>").agg(F.array(*(F.coalesce(F.sum(F.col("v")[j]), F.lit(0.0)) for j in range(topics))).alias("v"))
    by_word = gibbs.counts(partial(gibbs.each, text), topics).select(F.concat(F.lit("w:"), "w").alias("k"), F.col("c").cast("array<double>").alias("v"))
    model = gibbs.each(text, assigned, "k string, v array<double>").unionByName(by_word).unionByName(n.select(F.lit("n").alias("k"), "v"))
    store = Store(materialise(model.withColumn("t", F.lit(0).cast("long")), "lda"), small=False, own=True)
    vocabulary = store.df.filter("k like 'w:%'").count()
    gibbs.released(spark)
    swarm = PeerSwarm(store, {f"p{i}": ring_hash(i + 1) for i in range(peers)}, barriers.p2p_bsp, acts)

    def keys(block: int, part: int, every: list[pa.Array]) -> pa.RecordBatch:
        k = pa.concat_arrays(every)
        return pa.RecordBatch.from_arrays([pa.array([f"p{part}"] * len(k)), pa.repeat(pa.scalar(block, pa.int64()), len(k)), k], names=["peer", "block", "k"])

    def schedule(s: PeerSwarm, go: list[str]) -> DataFrame:
        step = s.rounds

        def wanted(block: int, part: int, b: gibbs.Block) -> Iterator[pa.RecordBatch]:
            start, least = hashlib.md5(f"{seed}:{step}:p{part}:".encode()), int((1 << 32) * min(1.0, share))

            def draw(w: bytes) -> bool:
                h = start.copy()
                h.update(w)
                return int.from_bytes(h.digest()[:4]) < least

            drawn_ = pa.array([draw(w) for w in b.names.cast(pa.binary()).to_pylist()], pa.bool_())
            yield keys(block, part, [doc_keys(b), word_keys(b).filter(drawn_), pa.array(["n"])])

        return gibbs.each(text.filter(F.concat(F.lit("p"), "part").isin(go)), wanted, "peer string, block long, k string")

    def topics_of(b: gibbs.Block, rows: pa.Table) -> np.ndarray:
        at = pc.index_in(doc_keys(b), value_set=rows["k"].combine_chunks())
        return rows["v"].combine_chunks().take(at).flatten().to_numpy().astype(np.uint16)

    def compute(wanted: DataFrame, store: DataFrame, steps: dict[str, int]) -> DataFrame:
        def sample(block: int, part: int, b: gibbs.Block, rows: pa.Table) -> pa.Table:
            step = steps[f"p{part}"]
            before, named = b._replace(z=topics_of(b, rows)), b._replace(names=word_keys(b))
            of, there = gibbs.matrix(named, [pa.table({"w": rows["k"], "c": rows["v"]}).filter(pc.starts_with(rows["k"], "w:"))], topics)
            n_k = np.array(rows.filter(pc.equal(rows["k"], "n"))["v"][0].as_py())
            z, _ = gibbs.sample(before, of, there, n_k, vocabulary, alpha, beta, lambda d: gibbs.stream([seed, step + 1], d))
            after = before._replace(z=z)
            off = (before.counts(topics) - after.counts(topics)).astype(float)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * topics, pa.int32()), pa.array(x.ravel()))
            k = pa.concat_arrays([doc_keys(b), named.names.filter(pa.array(there)), pa.array(["n"])])
            v = pa.concat_arrays([b.lists(pa.array(z, pa.float64())), lists(off[there]), lists(off.sum(0)[None])])
            return pa.table({"k": k, "v": v, "t": pa.array(np.full(len(k), step), pa.int64())})

        return gibbs.with_rows(text, wanted.join(store, "k").select("block", "k", "v"), sample, "k string, v array<double>, t long", touched=True)

    def pull(updates: DataFrame, store: DataFrame) -> DataFrame:
        gibbs.released(spark)  # updates are settled
        assigned_, rest = updates.filter("k like 'd:%'"), updates.filter("k not like 'd:%'")
        return last_write(assigned_, "t").unionByName(subtract_vectors(rest, store))

    swarm.register_schedule(schedule)
    swarm.register_compute(compute)
    swarm.register_pull(pull)
    swarm.start(rounds)
    gibbs.released(spark)

    own = gibbs.each(text, lambda block, part, b: iter([keys(block, part, [doc_keys(b)])]), "peer string, block long, k string")
    z = own.join(store.df.filter("k like 'd:%'"), "k").select("block", "k", "v")

    def over(f: Callable, schema: str) -> DataFrame:
        return gibbs.with_rows(text, z, lambda block, part, b, rows: pa.Table.from_batches(f(block, part, b._replace(z=topics_of(b, rows)))), schema)

    return over, store


class NdArray:
    """A distributed array as rows (i, value), i being the row-major position."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...]) -> None:
        self.df, self.shape = df, shape

    @classmethod
    def init(cls, spark: SparkSession, shape: tuple[int, ...], f: Column | Callable[[Column], Column]) -> NdArray:
        value = f(F.col("id")) if callable(f) and not isinstance(f, Column) else f
        return cls(spark.range(math.prod(shape)).select(F.col("id").alias("i"), value.cast("double").alias("value")), shape)

    @classmethod
    def ones(cls, spark: SparkSession, shape: tuple[int, ...]) -> NdArray:
        return cls.init(spark, shape, F.lit(1.0))

    @classmethod
    def uniform(cls, spark: SparkSession, shape: tuple[int, ...], seed: int) -> NdArray:
        """Uniform in [0, 1) by a hash of the position, so recomputation gives the same array."""
        return cls.init(spark, shape, lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53))

    def map(self, f: Callable[[Column], Column]) -> NdArray:
        return NdArray(self.df.select("i", f(F.col("value")).alias("value")), self.shape)

    def add(self, other: NdArray) -> NdArray:
        b = other.df.select("i", F.col("value").alias("__b"))
        return NdArray(self.df.join(b, "i").select("i", (F.col("value") + F.col("__b")).alias("value")), self.shape)

    def sum(self) -> float:
        return self.df.agg(F.sum("value")).first()[0] or 0.0

    def fold(self, f: Callable[[float, float], float], zero: float, inner: Column) -> float:
        return Dataset(self.df.select("value")).fold(f, zero, inner)

    def _at(self, index: tuple[int, ...]) -> int:
        return int(np.ravel_multi_index(index, self.shape))

    def get(self, index: tuple[int, ...]) -> float:
        return self.df.filter(F.col("i") == self._at(index)).first()["value"]

    def set(self, index: tuple[int, ...], value: float) -> NdArray:
        return NdArray(self.df.select("i", F.when(F.col("i") == self._at(index), F.lit(float(value))).otherwise(F.col("value")).alias("value")), self.shape)

    def to_ndarray(self) -> np.ndarray:
        out = np.zeros(math.prod(self.shape))
        for r in self.df.collect():
            out[r["i"]] = r["value"]
        return out.reshape(self.shape)
