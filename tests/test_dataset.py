import pytest
from pyspark.sql import functions as F

from parflow.context import Context
from parflow.operators.dataset import Dataset, apply
from parflow.sources import io


def numbers(spark, xs, parts=3):
    return Dataset(spark.createDataFrame([(float(x),) for x in xs], "value double").repartition(parts))


def pairs(spark, rows, parts=3):
    return Dataset(spark.createDataFrame(rows, "k string, v long").repartition(parts))


def flat(ds):
    return sorted(r[0] for r in ds.rows())


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_chain(spark, parts):
    x1 = numbers(spark, range(1, 11), parts).map((F.col("value") * 2).alias("value"))
    x3 = x1.union(x1.map("value + 3 as value"))
    x4 = x3.filter(F.lit(10) > F.col("value"))
    assert (x3.count(), x4.count()) == (20, 7)
    assert x3.fold(lambda a, b: a + b, 0.0) == 250 == x3.fold(lambda a, b: a + b, 0.0, F.sum("value"))
    assert x3.fold(max, 0.0) == 23
    x7 = x3.map("if(value > 10, 'a', 'b') as k", "value as v").reduce_by_key(F.max("v").alias("v"))
    assert dict(map(tuple, x7.rows())) == {"a": 23, "b": 10}


def test_callables(spark):
    d = numbers(spark, [1, 2, 3])
    assert flat(d.map(lambda x: x + 1, schema="value double")) == [2, 3, 4]
    assert flat(d.filter(lambda x: x > 1)) == [2, 3]
    assert flat(d.flatmap(lambda x: [x] * int(x), schema="value double")) == [1, 2, 2, 3, 3, 3]
    assert sum(r[0] for r in d.map_partition(lambda xs: [float(len(xs))], "value double").rows()) == 3
    assert dict(map(tuple, pairs(spark, [("a", 1), ("a", 2), ("b", 5)]).reduce_by_key(lambda a, b: a + b).rows())) == {"a": 3, "b": 5}


def test_reduce_by_key_callable_of_empty_tasks_and_nulls(spark):
    d = pairs(spark, [("a", 2**53 + 1), (None, 4)], 8)  # most tasks have no row
    assert dict(map(tuple, d.reduce_by_key(max).rows())) == {"a": 2**53 + 1, None: 4}
    d = pairs(spark, [("a", None), ("a", 2**53 + 1), ("b", None), (None, None), (None, -(2**63)), ("c", 2**63 - 1), ("c", None)], 1)
    assert dict(map(tuple, d.reduce_by_key(max).rows())) == {"a": 2**53 + 1, "b": None, None: -(2**63), "c": 2**63 - 1}
    assert pairs(spark, [], 2).reduce_by_key(max).rows() == []
    kinds = Dataset(spark.sql("select * from values (double('nan'), timestamp'2020-01-01'), (double('nan'), timestamp'2021-01-01'), (null, null) t(k, v)"))
    assert sorted(map(str, kinds.reduce_by_key(max).df.select(F.col("k").cast("string"), F.col("v").cast("string")).rdd.map(tuple).collect())) == ["('NaN', '2021-01-01 00:00:00')", "(None, None)"]


def test_zero_enters_fold_once(spark):
    assert numbers(spark, [1, 2, 3]).fold(lambda a, b: a + b, 10.0) == 16


def test_empty(spark):
    e = numbers(spark, [])
    assert e.reduce(F.max("value")) is None and e.reduce(max) is None
    assert e.fold(max, 4.0) == 4.0 and e.count() == 0


def test_join_is_an_untagged_outer_cogroup(spark):
    a, b = pairs(spark, [("x", 1), ("x", 2), ("y", 3)]), pairs(spark, [("x", 9), ("z", 4)])
    assert {r["k"]: sorted(r["v"]) for r in a.join(b).rows()} == {"x": [1, 2, 9], "y": [3], "z": [4]}
    assert {r["k"]: (sorted(r["left"]), sorted(r["right"])) for r in a.cogroup(b).rows()} == {"x": ([1, 2], [9]), "y": ([3], []), "z": ([], [4])}


def test_flatten_drops_empty_and_null(spark):
    d = Dataset(spark.createDataFrame([([1, 2],), ([],), (None,)], "value array<int>"))
    assert flat(d.flatten()) == [1, 2]


def test_shuffle_puts_a_key_in_one_partition(spark):
    d = pairs(spark, [(c, i) for i in range(20) for c in "abc"], 5).shuffle(4)
    parts = d.collect()
    assert len(parts) == 4
    for c in "abc":
        assert sum(any(r["k"] == c for r in p) for p in parts) == 1


def test_union_keeps_duplicates_and_seed(spark):
    d = numbers(spark, [1, 1])
    assert flat(d.union(d)) == [1] * 4
    assert Dataset.seed(spark).rows()[0][0] is None


def test_apply_checks_arity(spark):
    d = numbers(spark, [1])
    assert len(apply(lambda i: [i[0], i[0]], [d], 2)) == 2
    with pytest.raises(ValueError):
        apply(lambda i: i, [d], 2)


def test_broadcast_and_introspection(spark):
    c = Context(spark)
    k = c.broadcast({"x": 5})
    assert c.get_value(k) == {"x": 5} and c.workers() and c.myself()
    h = c.handle(k)
    assert flat(numbers(spark, [1]).map(lambda x: x + h.value["x"], schema="value double")) == [6]


def test_load_and_save(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("one two\nthree\n")
    assert io.load(spark, f"unix://{p}").rows()[0][0] == "one two\nthree\n"
    assert io.load(spark, f"text://{p}").count() == 2
    assert io.save(numbers(spark, [1, 2]), f"parquet://{tmp_path}/out") > 0
    assert io.load(spark, f"parquet://{tmp_path}/out").count() == 2
    for url in ("default", "nope://x"):
        with pytest.raises(ValueError):
            io.load(spark, url)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "id * 3 as c").write.parquet(f"{tmp_path}/t")
    plan = Dataset(spark.read.parquet(f"{tmp_path}/t")).filter("b > 10").map("id").df._jdf.queryExecution().toString()
    assert "GreaterThan(b,10)" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan
