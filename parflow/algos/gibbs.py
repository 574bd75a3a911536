"""Gibbs sampling of topics in blocks of documents, on Arrow batches and numpy.

A block is a row (block, part, payload): the payload holds some documents, their words as codes into the block's distinct words,
and topics. So the rows of the word-topic table are fetched once for a block, not for each document, and one step of the sampler
takes the next token of many documents at once.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType

#: Tokens of a block, if it has several documents; numbers in a chunk of the sampler, and in the rows that are sent to all.
BLOCK_TOKENS, CHUNK, HEAD = 600_000, 2_000_000, 1_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
KIND = "block long, part long, payload binary"
Batches = Iterator[pa.RecordBatch]


class Block(NamedTuple):
    docs: pa.Array
    sizes: np.ndarray
    names: pa.Array
    codes: np.ndarray
    z: np.ndarray

    def pack(self) -> bytes:
        columns = {"docs": self.docs, "sizes": pa.array(self.sizes, pa.int32()), "names": self.names, "codes": pa.array(self.codes, pa.int32()), "z": pa.array(self.z, pa.uint16())}
        batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in columns.values()], names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, payload: pa.Scalar) -> Block:
        columns = [c.flatten() for c in pa.ipc.open_stream(payload.as_buffer()).read_next_batch().columns]
        return cls(*(c if i in (0, 2) else c.to_numpy() for i, c in enumerate(columns)))

    def counts(self, topics: int) -> np.ndarray:
        """Tokens of each of its words by topic."""
        return np.bincount(self.codes.astype(np.int64) * topics + self.z, minlength=len(self.names) * topics).reshape(-1, topics)

    def lists(self, values: pa.Array) -> pa.Array:
        """An array with a value for each token, as a list for each document."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.sizes)]), pa.int32()), values)


def stream(seed: list[int], doc: int | None) -> np.random.Generator:
    return np.random.default_rng([*seed, (-1 if doc is None else doc) & 0xFFFFFFFF])


def blocks(docs: DataFrame, begin: Callable[[list, np.ndarray], np.ndarray], part: str = "0L") -> DataFrame:
    """Blocks of documents (doc long, words array<string>), each of one ``part``. Null lists count as empty, null words are left
    out. ``begin(docs, sizes)`` gives the first topics."""
    words = F.coalesce("words", F.array().cast("array<string>"))
    if not isinstance(kind := docs.schema["words"].dataType, ArrayType) or kind.containsNull:
        words = F.filter(words, lambda w: w.isNotNull())

    def run(batches: Batches) -> Batches:
        task, n = TaskContext.get().partitionId() << 32, 0
        for held in _gathered(batches):
            for one in np.unique(held["part"].to_numpy()):
                rows = held.filter(pc.equal(held["part"], one))
                lists = rows["words"].combine_chunks()
                sizes, coded = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32), lists.flatten().dictionary_encode()
                ids = rows["doc"].combine_chunks()
                block = Block(ids, sizes, coded.dictionary, coded.indices.to_numpy(), begin(ids.to_pylist(), sizes))
                yield pa.RecordBatch.from_arrays([pa.array([task + n]), pa.array([one], pa.int64()), pa.array([block.pack()], pa.binary())], names=["block", "part", "payload"])
                n += 1
            _trim()

    return docs.select("doc", words.alias("words"), F.expr(part).cast("long").alias("part")).mapInArrow(run, KIND)


def _gathered(batches: Batches) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        ends, start = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + BLOCK_TOKENS - n, "right")), start + (not held))
            if stop > start:
                held.append(b.slice(start, stop - start))
                n += ends[stop - 1] - before
            if stop < len(ends):
                yield pa.Table.from_batches(held)
                held, n = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def _trim() -> None:
    """Give what was freed back, so that a worker's memory is that of one block."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def each(rows: DataFrame, f: Callable[[int, int, Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f(block, part, content)`` of every block."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for i in range(b.num_rows):
                yield from f(b.column(0)[i].as_py(), b.column(1)[i].as_py(), Block.unpack(b.column(2)[i]))
                _trim()

    return rows.select("block", "part", "payload").mapInArrow(run, schema)


def with_rows(held: DataFrame, rows: DataFrame, f: Callable[[int, int, Block, pa.Table], pa.Table], schema: str, touched: bool = False) -> DataFrame:
    """``f(block, part, content, rows)`` of every block and the rows (block, ...) that belong to it; with ``touched``, only of the
    blocks that have rows."""
    empty = to_arrow_schema(held.sparkSession.createDataFrame([], schema).schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("rows of a block that is not there")
        if touched and not right.num_rows:
            return empty
        _trim()
        return f(left["block"][0].as_py(), left["part"][0].as_py(), Block.unpack(left["payload"][0]), right)

    return held.select("block", "part", "payload").groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)


def _counted(names: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    topics = counts.shape[1]
    return pa.RecordBatch.from_arrays([names, *(pa.array(counts[:, j], pa.int64()) for j in range(topics))], names=["w", *(f"c{j}" for j in range(topics))])


def _summed(partial: DataFrame, topics: int) -> DataFrame:
    return partial.groupBy("w").agg(F.array(*(F.sum(f"c{j}") for j in range(topics))).alias("c"))


def _kind(topics: int) -> str:
    return "w string, " + ", ".join(f"c{j} long" for j in range(topics))


def counts(over: Callable[[Callable, str], DataFrame], topics: int) -> DataFrame:
    """(w, c): tokens of each word by topic, over the blocks that ``over(f, schema)`` runs a function on."""
    return _summed(over(lambda block, part, b: iter([_counted(b.names, b.counts(topics))]), _kind(topics)), topics)


def table(held: DataFrame, topics: int) -> DataFrame:
    """(w, c, at): tokens of each word by topic, and the blocks that hold it."""

    def own(block: int, part: int, b: Block) -> Batches:
        rows = _counted(b.names, b.counts(topics))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.repeat(pa.scalar(block, pa.int64()), len(b.names))], names=[*rows.schema.names, "block"])

    def merged(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sums = np.add.reduceat(np.stack([rows[f"c{j}"].to_numpy() for j in range(topics)], 1), starts, axis=0)
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        c = lists(pa.array(sums.ravel(), pa.int64()), np.arange(len(starts) + 1) * topics)
        return pa.RecordBatch.from_arrays([rows["w"].take(pa.array(starts)).combine_chunks(), c, lists(rows["block"].combine_chunks(), np.append(starts, rows.num_rows))], names=["w", "c", "at"])

    def merge(batches: Batches) -> Batches:
        """Rows come sorted by word; those of the last word wait for the next batch."""
        left: list = []
        for b in batches:
            rows = pa.Table.from_batches([*left, b]).combine_chunks()
            w = rows["w"].combine_chunks()
            starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False)))
            left = rows.slice(starts[-1]).to_batches()
            if len(starts) > 1:
                yield merged(rows.slice(0, starts[-1]), starts[:-1])
        if left:
            yield merged(pa.Table.from_batches(left), np.array([0]))

    return each(held, own, _kind(topics) + ", block long").repartition("w").sortWithinPartitions("w").mapInArrow(merge, "w string, c array<long>, at array<long>")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python of a few MB while tables of documents and blocks are made, as executors hold several of them."""
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(2_000_000))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if was is None else spark.conf.set(BATCH_BYTES, was)


def released(spark: SparkSession) -> None:
    """Let go of shuffles that nothing needs any more: Spark drops their files when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(block: int, part: int, b: Block) -> Iterator[pa.RecordBatch]:
    """(doc, words, z) of a block."""
    yield pa.RecordBatch.from_arrays([b.docs, b.lists(b.names.take(pa.array(b.codes))), b.lists(pa.array(b.z, pa.int32()))], names=["doc", "words", "z"])


def common(rows: DataFrame, topics: int) -> tuple[DataFrame, pa.Table]:
    """Of a :func:`table` the words of several blocks: (block, w, c), and apart, (w, c) of those in the most blocks, which are
    cheaper to send to all."""
    many = rows.filter("size(at) > 1")
    left, least = HEAD // topics, 1 << 30
    for r in many.groupBy(F.size("at").alias("n")).count().orderBy(F.desc("n")).toLocalIterator():
        left -= r["count"]
        if left < 0:
            break
        least = r["n"]
    return many.filter(F.size("at") < least).select(F.explode("at").alias("block"), "w", "c"), many.filter(F.size("at") >= least).select("w", "c").toArrow()


def matrix(b: Block, tables: list[pa.Table], topics: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (w, c) by the block's codes, and which codes have one."""
    out, there = np.zeros((len(b.names), topics)), np.zeros(len(b.names), bool)
    for t in tables:
        at = pc.index_in(t["w"], value_set=b.names).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        out[at[at >= 0]] = t["c"].combine_chunks().flatten().to_numpy().reshape(-1, topics)[at >= 0]
        there[at[at >= 0]] = True
    return out, there


def sample(b: Block, rows: np.ndarray, there: np.ndarray, n_k: np.ndarray, vocabulary: int, alpha: float, beta: float, draws: Callable[[int | None], np.random.Generator]) -> tuple[np.ndarray, float]:
    """New topics of all tokens, and the log-likelihood of those that were drawn anew: tokens of the words that are ``there``.
    Each document starts from ``rows`` (changed in place) and ``n_k`` and sees its own changes, token after token; documents do not see each other."""
    topics = len(n_k)
    doc_of = np.repeat(np.arange(len(b.sizes), dtype=np.int32), b.sizes)
    n_d = np.bincount(doc_of.astype(np.int64) * topics + b.z, minlength=len(b.sizes) * topics).reshape(-1, topics) + alpha / topics
    rows += beta
    n_k = n_k + vocabulary * beta
    drawn = np.flatnonzero(there[b.codes]).astype(np.int32)
    sizes = np.bincount(doc_of[drawn], minlength=len(b.sizes))
    u = np.concatenate([draws(d).random(n) if n else np.empty(0) for d, n in zip(b.docs.to_pylist(), sizes)] or [np.empty(0)])
    firsts, z, ll = np.cumsum(sizes) - sizes, b.z.copy(), 0.0
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    start, ends = 0, np.cumsum(sizes[order])
    while start < len(order):  # documents of like length go together, the longest first
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK // topics, "right")), start + 1)
        docs = order[start:stop]
        size = sizes[docs]
        first = np.cumsum(size) - size
        step = np.arange(size.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        by_step = np.argsort(step, kind="stable")
        who = np.repeat(np.arange(len(docs)), size)[by_step]
        at = (np.repeat(firsts[docs], size) + step)[by_step]
        tokens = drawn[at]
        pair, keys = pd.factorize(who * len(b.names) + b.codes[tokens])
        z[tokens], sums = _chain(n_d[docs], rows[keys % len(b.names)], np.tile(n_k, (len(docs), 1)), pair, z[tokens].astype(np.int64), u[at], len(docs) - np.searchsorted(size[::-1], np.arange(size[0]), "right"))
        ll += float(np.log(sums / (b.sizes[docs][who] - 1 + alpha)).sum())
        start = stop
    return z, ll


def _chain(n_d: np.ndarray, rows: np.ndarray, n_k: np.ndarray, pair: np.ndarray, z: np.ndarray, u: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens are ordered by their place in a document; of each place the first ``active`` documents have one. Counts are smoothed;
    rows fetched late may be lower than a document's own tokens, so what is negative counts as nothing."""
    topics, sums = n_d.shape[1], np.empty(len(z))
    d, r, o, base, e = n_d.reshape(-1), rows.reshape(-1), n_k.reshape(-1), np.arange(len(n_d)) * topics, 0
    for a in active:
        s, e = e, e + a
        j, doc, word = pair[s:e], base[:a] + z[s:e], pair[s:e] * topics + z[s:e]
        d[doc] -= 1
        o[doc] -= 1
        r[word] -= 1
        p = np.maximum(n_d[:a], 0)
        p *= np.maximum(rows[j], 0)
        p /= np.maximum(n_k[:a], 1e-9)
        np.cumsum(p, axis=1, out=p)
        sums[s:e] = total = p[:, -1]
        k = (p <= (u[s:e] * total)[:, None]).sum(1)
        np.minimum(k, topics - 1, out=k)
        z[s:e] = k
        doc, word = base[:a] + k, j * topics + k
        d[doc] += 1
        o[doc] += 1
        r[word] += 1
    return z, sums
