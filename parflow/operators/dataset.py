"""Bag operators on distributed datasets, as DataFrame plans.

Every operator takes a Column or SQL expression first; Catalyst then sees it, pushes filters down, prunes columns and fuses the
chain. A Python callable is taken too where an expression cannot say it: it runs on Arrow batches and needs a schema. Callables
get a plain value where the dataset has one column, else a tuple. Transforms are lazy, actions run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Expr = Column | str


def _column(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def _elements(frame: pd.DataFrame) -> Iterable[Any]:
    return frame.iloc[:, 0] if frame.shape[1] == 1 else frame.itertuples(index=False, name=None)


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({names[0]: pd.Series(rows, dtype=object)}) if len(names) == 1 else pd.DataFrame.from_records(rows, columns=names)


_NAN = float("nan")


def _values(column: pa.Array | pa.ChunkedArray) -> Iterable[Any]:
    """Its values as pandas has them, but None for nulls: integers stay integers beside them."""
    if not column.null_count:
        return column.to_pandas(date_as_object=True)
    left = iter(column.drop_null().to_pandas(date_as_object=True))
    return (next(left) if there else None for there in column.is_valid().to_pylist())


class Dataset:
    """A bag of rows. Pair datasets have the columns k and v."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def seed(cls, spark) -> Dataset:
        """One element, null."""
        return cls(spark.range(1).select(F.lit(None).cast("string").alias("value")))

    def _schema(self, schema: str | StructType) -> StructType:
        return schema if isinstance(schema, StructType) else self.df.sparkSession.createDataFrame([], schema).schema

    # -- row transforms (narrow)
    def map(self, *f: Expr | Callable[[Any], Any], schema: str | StructType | None = None) -> Dataset:
        if not callable(f[0]) or isinstance(f[0], Column):
            return Dataset(self.df.select(*map(_column, f)))
        fn, kind = f[0], self._schema(schema)
        return Dataset(self.df.mapInPandas(lambda it: (_frame([fn(x) for x in _elements(p)], kind.names) for p in it), kind))

    def filter(self, p: Expr | Callable[[Any], bool]) -> Dataset:
        """Keep where true; a null condition drops the row."""
        if not callable(p) or isinstance(p, Column):
            return Dataset(self.df.filter(_column(p)))
        return Dataset(self.df.mapInPandas(lambda it: (f[[bool(p(x)) for x in _elements(f)]] for f in it), self.df.schema))

    def flatten(self, column: str | None = None) -> Dataset:
        """One row for each element of an array column, one level; empty and null arrays vanish."""
        c = column or self.df.columns[0]
        return Dataset(self.df.select(*(F.explode(x).alias(x) if x == c else F.col(x) for x in self.df.columns)))

    def flatmap(self, f: Expr | Callable[[Any], list], name: str = "value", schema: str | StructType | None = None) -> Dataset:
        if not callable(f) or isinstance(f, Column):
            return Dataset(self.df.select(F.explode(_column(f)).alias(name)))
        kind = self._schema(schema)
        return Dataset(self.df.mapInPandas(lambda it: (_frame([y for x in _elements(p) for y in f(x)], kind.names) for p in it), kind))

    def map_partition(self, f: Callable[[list], Iterable], schema: str | StructType) -> Dataset:
        """``f`` gets one whole partition as a list and may change the number of rows: the one operator that must hold a
        partition. For work that only needs batches use :meth:`map_batches`."""
        kind, one = self._schema(schema), len(self.df.columns) == 1

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [x if one else tuple(x) for p in frames for x in _elements(p)]
            yield _frame(list(f(rows)), kind.names)

        return Dataset(self.df.mapInPandas(run, kind))

    def map_batches(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> Dataset:
        return Dataset(self.df.mapInPandas(lambda it: map(f, it), schema))

    def sample(self, fraction: float, seed: int, key: str | list[str] | None = None) -> Dataset:
        """Each row with probability ``fraction``; the seed fixes the draw. With a ``key`` a digest of it decides, so the draw
        does not depend on how rows lie in partitions, and rows of one key are drawn together."""
        if key is None:
            return Dataset(self.df.sample(fraction, seed))
        digest = F.md5(F.concat_ws(":", F.lit(seed), *([key] if isinstance(key, str) else key)).cast("binary"))
        return Dataset(self.df.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int((1 << 32) * fraction)))

    # -- partitions and sets
    def union(self, other: Dataset) -> Dataset:
        """Bag union; duplicates stay."""
        return Dataset(self.df.union(other.df))

    def shuffle(self, n: int | None = None, key: str = "k") -> Dataset:
        """The same rows, those of one key in one partition. Without ``n`` adaptive execution sizes the partitions."""
        return Dataset(self.df.repartition(n, key) if n else self.df.repartition(key))

    # -- keys
    def join(self, other: Dataset) -> Dataset:
        """(k, list of v) over both sides together, untagged; keys of one side stay. The list's order is not defined."""
        return Dataset(self.df.select("k", "v").union(other.df.select("k", "v")).groupBy("k").agg(F.collect_list("v").alias("v")))

    def join_counts(self, other: Dataset) -> Dataset:
        """As :meth:`join`, but each key's number of values: combines before the shuffle, so a hot key is one row a task."""
        return Dataset(self.df.select("k").union(other.df.select("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")))

    def cogroup(self, other: Dataset) -> Dataset:
        """(k, left list, right list): the tagged form of :meth:`join`."""
        side = lambda d, t: d.df.select("k", F.when(F.lit(t), F.col("v")).alias("a"), F.when(F.lit(not t), F.col("v")).alias("b"))
        return Dataset(side(self, True).union(side(other, False)).groupBy("k").agg(F.collect_list("a").alias("left"), F.collect_list("b").alias("right")))

    def reduce_by_key(self, *f: Column | Callable[[Any, Any], Any], key: str | list[str] = "k") -> Dataset:
        """Aggregate columns per key, with partial aggregates before the shuffle. A callable (a, b) -> a over v must be
        commutative and associative; it too combines before the shuffle. Like aggregates it is not given nulls; a key that has
        nothing else gets null."""
        keys = [key] if isinstance(key, str) else key
        if isinstance(f[0], Column):
            return Dataset(self.df.groupBy(*keys).agg(*f))
        fn, k = f[0], keys[0]
        pairs = self.df.select(k, "v")

        def packed(held: dict, kind: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip((held, held.values()), kind.types)], schema=kind)

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each key that a task meets; handed on before they grow too many. A task without rows gives none."""
            held: dict = {}
            for b in batches:
                for x, v in zip(b.column(0).to_pylist(), _values(b.column(1))):
                    x = _NAN if x != x else x
                    a = held.get(x)
                    held[x] = v if a is None else a if v is None else fn(a, v)
                if len(held) > 200_000:
                    yield packed(held, b.schema)
                    held = {}
            if held:
                yield packed(held, b.schema)

        def merge(p: pa.Table) -> pa.Table:
            return pa.Table.from_batches([packed({p.column(0)[0].as_py(): _fold((v for v in _values(p.column(1)) if v is not None), fn)}, p.schema)])

        return Dataset(pairs.mapInArrow(combine, pairs.schema).groupBy(k).applyInArrow(merge, pairs.schema))

    def group_by_key(self) -> Dataset:
        return Dataset(self.df.groupBy("k").agg(F.collect_list("v").alias("v")))

    def ungroup(self) -> Dataset:
        return self.flatten("v")

    # -- actions
    def reduce(self, f: Column | Callable[[Any, Any], Any]) -> Any:
        """None for an empty dataset."""
        if isinstance(f, Column):
            return self.df.agg(f).first()[0]
        return _fold(self._partials(f), f)

    def fold(self, f: Callable[[Any, Any], Any], zero: Any, inner: Column | None = None) -> Any:
        """Partitions fold from their first element, without the zero; the zero enters once, on the driver. ``inner``: the
        aggregate to use for the partitions instead of ``f``."""
        if inner is not None:
            x = self.df.agg(inner).first()[0]
            return zero if x is None else f(zero, x)
        for x in self._partials(f):
            zero = f(zero, x)
        return zero

    def _partials(self, f: Callable[[Any, Any], Any]) -> list:
        one = len(self.df.columns) == 1

        def run(rows: Iterator) -> Iterator:
            x = _fold((r[0] if one else tuple(r) for r in rows), f)
            if x is not None:
                yield x

        return self.df.rdd.mapPartitions(run).collect()

    def count(self) -> int:
        return self.df.count()

    def bounded_count(self, timeout_ms: int, confidence: float = 0.95) -> int:
        """What is counted within the time: a delay-bounded barrier."""
        return int(self.df.rdd.countApprox(timeout_ms, confidence))

    def collect(self) -> list[list]:
        """One list per partition."""
        return self.df.rdd.glom().collect()

    def rows(self) -> list:
        return self.df.collect()

    def cache(self) -> Dataset:
        self.df.persist()
        return self


def _fold(items: Iterable, f: Callable[[Any, Any], Any]) -> Any:
    out = None
    for x in items:
        out = x if out is None else f(out, x)
    return out


def apply(f: Callable[[list[Dataset]], list[Dataset]], inputs: list[Dataset], n_out: int) -> list[Dataset]:
    """n inputs to m outputs; the number of outputs is checked."""
    out = list(f(inputs))
    if len(out) != n_out:
        raise ValueError(f"{len(out)} outputs, {n_out} expected")
    return out
