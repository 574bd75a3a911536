"""One query for each operator, and the SQL that it must agree with."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parflow.algos import gibbs, programs
from parflow.functions.scalars import exact_sum, nth, parse_float, split
from parflow.operators.dataset import Dataset, apply
from parflow.plans import barriers, params, ring

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: Dataset(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            return out.df if isinstance(out, Dataset) else out

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as disc_price from lineitem")
def map(t):  # noqa: A001
    return t("lineitem").map("l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) as disc_price")


@query("select o_orderkey, o_totalprice * 2 as doubled from orders")
def map_partition(t):
    return t("orders").map("o_orderkey", "o_totalprice").map_partition(lambda rows: [(k, v * 2) for k, v in rows], "o_orderkey long, doubled double")


@query("select o_orderkey, o_totalprice * 2 as doubled from orders")
def map_batches(t):
    return t("orders").map("o_orderkey", "o_totalprice").map_batches(lambda p: pd.DataFrame({"o_orderkey": p.o_orderkey, "doubled": p.o_totalprice * 2}), "o_orderkey long, doubled double")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where 10 > l_quantity")
def filter(t):  # noqa: A001
    return t("lineitem").filter(F.lit(10) > F.col("l_quantity")).map("l_orderkey", "l_linenumber", "l_quantity")


@query("select vec_id, unnest(embedding) as v from embeddings")
def flatten(t):
    return t("embeddings").map("vec_id", "embedding as v").flatten("v")


@query("select doc_id, unnest(regexp_split_to_array(text, '[ \t\n]')) as w from documents")
def flatmap(t):
    return t("documents").map("doc_id", split(F.col("text")).alias("w")).flatten("w")


_stop = ",".join(f"'{w}'" for w in programs.STOP_WORDS)


@query(f"select w, count(*) as n from (select translate(unnest(regexp_split_to_array(text, '[ \t\n]')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents) t where strlen(w) > 0 and w not in ({_stop}) group by w")
def flatmap_filter_wordcount(t):
    return programs.word_count(t("documents"), "text")


@query("select c_nationkey as k from customer union all select s_nationkey as k from supplier")
def union(t):
    return t("customer").map("c_nationkey as k").union(t("supplier").map("s_nationkey as k"))


@query("select n_name from nation union all select n_name from nation")
def union_self(t):
    x = t("nation").map("n_name")
    return x.union(x)


@query("select o_custkey, o_orderkey from orders")
def shuffle(t):
    return t("orders").map("o_custkey", "o_orderkey").shuffle(key="o_custkey")


@query("select l_returnflag, l_linestatus, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as s from lineitem group by 1, 2")
def reduce_by_key_sum(t):
    return t("lineitem").reduce_by_key(exact_sum("l_extendedprice").alias("s"), key=["l_returnflag", "l_linestatus"])


@query("select event_type, max(value) as m from events group by 1")
def reduce_by_key_max(t):
    return t("events").reduce_by_key(F.max("value").alias("m"), key="event_type")


@query("select case when value > 50 then 'a' else 'b' end as k, max(value) as m from events group by 1")
def reduce_by_key_conditional(t):
    return t("events").map("case when value > 50 then 'a' else 'b' end as k", "value as v").reduce_by_key(F.max("v").alias("m"))


@query("select o_orderpriority, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*), 4) as mean_price from orders group by 1")
def reduce_by_key_mean(t):
    pairs = t("orders").reduce_by_key(exact_sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"), key="o_orderpriority")
    return pairs.map("o_orderpriority", "round(s / n, 4) as mean_price")


def _row(t, value, schema: str) -> DataFrame:
    return t("region").df.sparkSession.createDataFrame([(value,)], schema)


@query("select max(o_totalprice) as m from orders")
def reduce(t):
    return _row(t, t("orders").map("o_totalprice").reduce(F.max("o_totalprice")), "m double")


@query("select max(l_linenumber) as m from lineitem")
def reduce_callable(t):
    return _row(t, t("lineitem").map("l_linenumber").reduce(lambda a, b: max(a, b)), "m int")


@query("select max(o_totalprice) as m from orders where o_totalprice < 0")
def reduce_empty(t):
    return _row(t, t("orders").filter("o_totalprice < 0").map("o_totalprice").reduce(F.max("o_totalprice")), "m double")


@query("select greatest(cast(0 as double), coalesce(max(value), 0)) as m from events")
def fold_max(t):
    return _row(t, t("events").map("value").fold(lambda a, b: max(a, b), 0.0, F.max("value")), "m double")


@query("select cast(1000 + coalesce(sum(l_linenumber), 0) as bigint) as s from lineitem")
def fold_sum(t):
    return _row(t, t("lineitem").map("l_linenumber").fold(lambda a, b: a + b, 1000), "s long")


@query("select count(*) as n from lineitem where l_discount > 0.05")
def count(t):
    return _row(t, t("lineitem").filter("l_discount > 0.05").count(), "n long")


@query("select r_regionkey, r_name from region")
def collect(t):
    parts = t("region").map("r_regionkey", "r_name").collect()
    return t("region").df.sparkSession.createDataFrame([tuple(r) for p in parts for r in p], "r_regionkey int, r_name string")


@query("select o_orderpriority as k, max(o_custkey) as v from orders group by 1")
def reduce_by_key_callable(t):
    return t("orders").map("o_orderpriority as k", "o_custkey as v").reduce_by_key(lambda a, b: max(a, b))


@query("select o_custkey as k, array_to_string(list_sort(list(o_orderkey)), ',') as vs from orders group by 1")
def group_by_key(t):
    return t("orders").map("o_custkey as k", "o_orderkey as v").group_by_key().map("k", "array_join(cast(array_sort(v) as array<string>), ',') as vs")


@query("select o_custkey as k, o_orderkey as v from orders")
def ungroup(t):
    return t("orders").map("o_custkey as k", "o_orderkey as v").group_by_key().ungroup()


@query("select k, coalesce(array_to_string(list_sort(list(a) filter (a is not null)), ','), '') as l, coalesce(array_to_string(list_sort(list(b) filter (b is not null)), ','), '') as r from (select o_custkey as k, o_orderkey as a, null as b from orders union all select c_custkey, null, c_custkey from customer) t group by k")
def cogroup(t):
    both = t("orders").map("o_custkey as k", "o_orderkey as v").cogroup(t("customer").map("c_custkey as k", "c_custkey as v"))
    return both.map("k", "array_join(cast(array_sort(left) as array<string>), ',') as l", "array_join(cast(array_sort(right) as array<string>), ',') as r")


@query("select k, array_to_string(list_sort(list(v)), ',') as vs from (select o_custkey as k, o_orderkey as v from orders union all select c_custkey, c_custkey from customer) t group by k")
def join(t):
    both = t("orders").map("o_custkey as k", "o_orderkey as v").join(t("customer").map("c_custkey as k", "c_custkey as v"))
    return both.map("k", "array_join(cast(array_sort(v) as array<string>), ',') as vs")


@query("select k, count(*) as n from (select c_nationkey as k from customer where c_nationkey < 10 union all select s_nationkey from supplier where s_nationkey >= 5) t group by k")
def join_one_sided(t):
    return t("customer").filter("c_nationkey < 10").map("c_nationkey as k").join_counts(t("supplier").filter("s_nationkey >= 5").map("s_nationkey as k"))


@query("select s_suppkey, s_acctbal > (select cast(avg(cast(s_acctbal as decimal(18,2))) as double) from supplier) as above from supplier")
def broadcast_value(t):
    from parflow.context import Context

    rows = t("supplier").map("s_suppkey", "s_acctbal")
    context = Context(rows.df.sparkSession)
    handle = context.handle(context.broadcast(rows.reduce(exact_sum("s_acctbal") / F.count(F.lit(1)))))
    return rows.map(lambda r: (r[0], r[1] > handle.value), schema="s_suppkey long, above boolean")


@query("select cast(avg(cast(s_acctbal as decimal(18,2))) as double) as mean from supplier")
def get_value(t):
    from parflow.context import Context

    rows = t("supplier").map("s_acctbal")
    context = Context(rows.df.sparkSession)
    return _row(t, context.get_value(context.broadcast(rows.reduce(exact_sum("s_acctbal") / F.count(F.lit(1))))), "mean double")


@query("select case when k < 3 then 'a' when k < 5 then 'b' else 'c' end as kind, k from (select n_nationkey % 7 as k from nation) t where k <> 6")
def scalars(t):
    rows = t("nation").map("n_nationkey % 7 as k", "array(cast(n_nationkey % 7 as string), 'x') as pair")
    return rows.filter(parse_float(nth("pair", 0)) != 6.0).map("case when k < 3 then 'a' when k < 5 then 'b' else 'c' end as kind", "k")


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def broadcast_lookup(t):
    return t("customer").df.join(t("nation").df, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("select r_name as name from region union all select n_name from nation")
def apply_two(t):
    return apply(lambda d: [d[0].union(d[1]), d[0]], [t("region").map("r_name as name"), t("nation").map("n_name as name")], 2)[0]


QUERIES["apply"], ORACLES["apply"] = QUERIES.pop("apply_two"), ORACLES.pop("apply_two")


@query("select user_id as k, arg_max(value, event_id) as v, max(event_id) as t from events group by 1")
def param_set_get(t):
    return params.last_write(t("events").map("user_id as k", "value as v", "event_id").df, "event_id")


@query("select distinct user_id as k from events")
def param_keys(t):
    return params.Store(t("events").df.select(F.col("user_id").alias("k")).distinct()).keys()


@query("select user_id as k, cast(10000 - sum(cast(value as decimal(18,2))) as double) as v, max(event_id) as t from events group by 1")
def param_pull_merge(t):
    updates = t("events").map("user_id as k", "cast(value as decimal(18,2)) as v", "event_id as t").df
    store = updates.select("k", F.lit(10000).cast("decimal(18,2)").alias("v"), F.lit(0).cast("long").alias("t")).distinct()
    return params.subtract(updates, store).select("k", F.col("v").cast("double").alias("v"), "t")


_store = "(select user_id as k, count(*)::double as v from events group by 1)"


def _halving(t) -> tuple[params.Store, DataFrame]:
    """A store with a value for each user; every step halves what it is asked for."""
    rows = t("events").df.groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"), F.lit(0).cast("long").alias("t"))
    return params.Store(rows)


def _halve(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"k": frame["k"], "v": frame["v"] / 2})


def _run(t, barrier: str, rounds: int, slow: int = 1) -> DataFrame:
    """Four workers, each with the keys of its number; the first takes ``slow`` rounds over a task."""
    ps = params.ParamServer(_halving(t), [f"w{i}" for i in range(4)], barrier, lambda w, n: w != "w0" or n % slow == 0)
    ps.register_schedule(lambda go, store: store.select(F.concat(F.lit("w"), F.col("k") % 4).alias("worker"), "k", "v"))
    ps.register_push(_halve)
    ps.register_pull(params.subtract)
    return ps.start(rounds).df


@query(f"select k, v / 8 as v, 3::bigint as t from {_store}")
def param_run(t):
    return _run(t, "bsp", 3)


@query(f"select k, v / power(2, n) as v, n::bigint as t from (select *, case when k % 4 = 0 then 2 else 2 end as n from {_store}) t")
def param_run_bsp_slow(t):
    return _run(t, "bsp", 6, 3)  # all wait for the slow worker, who hands in at rounds 3 and 6


@query(f"select k, v / power(2, n) as v, n::bigint as t from (select *, case when k % 4 = 0 then 2 else 3 end as n from {_store}) t")
def param_run_ssp_slow(t):
    return _run(t, "ssp", 6, 3)  # the others are one step ahead, and no more


@query(f"select k, v / power(2, n) as v, n::bigint as t from (select *, case when k % 4 = 0 then 2 else 6 end as n from {_store}) t")
def param_run_asp_slow(t):
    return _run(t, "asp", 6, 3)


@query(f"select 4::bigint as workers, count(*) as n_keys, max(v) as top from {_store}")
def param_introspection(t):
    ps = params.ParamServer(_halving(t), [f"w{i}" for i in range(4)])
    ps.set(-1, 1e9)
    top = ps.store.df.filter("k >= 0").orderBy(F.desc("v"), "k").first()["k"]
    return t("region").df.sparkSession.createDataFrame([(ps.worker_num(), ps.keys().filter("k >= 0").count(), ps.get(top)[0])], "workers long, n_keys long, top double")


def _swarm(t, rounds: int, barrier=None, slow: int = 1) -> params.PeerSwarm:
    nodes = ring.nodes_of(t("nation").df, "n_name", "n_nationkey")
    names = sorted(nodes)
    swarm = params.PeerSwarm(_halving(t), nodes, barrier, lambda p, n: p != names[0] or n % slow == 0)
    swarm.register_schedule(lambda s, go: s.owners().select(F.col("owner").alias("peer"), "k"))
    swarm.register_push(_halve)
    swarm.register_pull(params.subtract)
    swarm.start(rounds)
    return swarm


_owned = "n as (select n_name, (cast(n_nationkey as bigint) * 2654435761) % 1073741824 as h from nation), o as (select s.k, s.v, arg_min(n_name, (n.h - (s.k * 2654435761) % 1073741824 + 1073741824) % 1073741824) as owner from s cross join n group by 1, 2)"


@query(f"with s as {_store} select k, v / 8 as v, 2::bigint as t from s")
def peer_run(t):
    return _swarm(t, 3, barriers.p2p_bsp).store.df


@query(f"with s as {_store}, {_owned} select k, v / case when owner = (select min(n_name) from nation) then 4 else 4 end as v, 1::bigint as t from o")
def peer_run_bsp_slow(t):
    return _swarm(t, 5, barriers.p2p_bsp, 2).store.df  # released in rounds 2 and 4, when the slow peer has come; what was sent in round 5 waits


@query(f"with s as {_store}, {_owned} select k, v / case when owner = (select min(n_name) from nation) then 4 else 32 end as v, case when owner = (select min(n_name) from nation) then 1 else 4 end::bigint as t from o")
def peer_run_asp_slow(t):
    return _swarm(t, 5, None, 2).store.df


@query(f"with s as {_store} select k, case when k = 7 then 0.5 else v end as v, 0::bigint as t from s")
def peer_set(t):
    swarm = _swarm(t, 0)
    swarm.set(7, 0.5, client=sorted(swarm.peers)[0])  # kept until the owner's barrier
    assert swarm.get(7)[0] != 0.5
    swarm.register_schedule(lambda s, go: None)
    swarm.register_pull(lambda updates, store: params.last_write(updates, "t"))
    return swarm.start(1).df


def _progress(t) -> DataFrame:
    return t("events").df.groupBy(F.col("user_id").alias("worker")).agg(F.count(F.lit(1)).alias("step"), (F.max("event_id") % 2).alias("busy"))


_ws = "ws as (select user_id as worker, count(*) as step, max(event_id) % 2 as busy from events group by 1), points as (select unnest([(select min(step) from ws), (select min(step) from ws) + 1, (select max(step) from ws)]) as now, unnest(['low', 'next', 'high']) as point), f as (select point, now, now + case when (select count(*) from ws where step >= now) = (select count(*) from ws) then 1 else 0 end as t from points)"


def _at_steps(t, rule: str, stale: int = 1) -> DataFrame:
    """The rule at the step that all have finished, at the next, and at one that almost nobody has."""
    ws, out = _progress(t), None
    for point, now in (("low", F.min("step")), ("next", F.min("step") + 1), ("high", F.max("step"))):
        one = barriers.admitted(ws, rule, ws.agg(now.alias("now")), stale).withColumn("point", F.lit(point))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_ws} select point, worker, t from f cross join ws where t > now")
def barrier_bsp(t):
    return _at_steps(t, "bsp")


@query(f"with {_ws} select point, worker, t from f cross join ws where busy = 0 and step - t < 5")
def barrier_ssp(t):
    return _at_steps(t, "ssp", 5)


@query(f"with {_ws} select point, worker, t from f cross join ws where busy = 0")
def barrier_asp(t):
    return _at_steps(t, "asp")


_peers = "with p as (select user_id as peer, count(*) as step, max(event_id) % 2 = 0 as blocked from events group by 1) select peer from p where "


def _peer_steps(t) -> DataFrame:
    return t("events").df.groupBy(F.col("user_id").alias("peer")).agg(F.count(F.lit(1)).alias("step"), (F.max("event_id") % 2 == 0).alias("blocked"))


@query(_peers + "blocked and not exists (select 1 from p q where q.step < p.step)")
def barrier_p2p_bsp(t):
    return barriers.p2p_admitted(_peer_steps(t), "bsp")


@query(_peers + "true")
def barrier_p2p_asp(t):
    return barriers.p2p_admitted(_peer_steps(t), "asp")


@query(_peers + "blocked")
def barrier_p2p_asp_local(t):
    return barriers.p2p_admitted(_peer_steps(t), "asp_local")


_ring = "with n as (select n_name, (cast(n_nationkey as bigint) * 2654435761) % 1073741824 as h from nation), k as (select c_custkey, (c_custkey * 2654435761) % 1073741824 as h from customer) select c_custkey, {}(n_name, (n.h - k.h + 1073741824) % 1073741824) as owner from k cross join n group by 1"


def _owner(t, far: bool) -> DataFrame:
    nodes = ring.nodes_of(t("nation").df, "n_name", "n_nationkey")
    return t("customer").df.select("c_custkey", ring.owner(ring.ring_hash(F.col("c_custkey")), nodes, far).alias("owner"))


@query(_ring.format("arg_min"))
def peer_owner(t):
    return _owner(t, False)


@query(_ring.format("arg_max"))
def peer_furthest(t):
    return _owner(t, True)


@query("with p as (select o_orderkey as id, o_totalprice / 100000.0 as x, cast(o_custkey % 7 as double) as y from orders), c0(k, cx, cy) as (values (0, cast(1 as double), cast(1 as double)), (1, 2, 2), (2, 3, 3), (3, 4, 4)), a1 as (select id, x, y, k from p cross join c0 qualify row_number() over (partition by id order by (x-cx)*(x-cx)+(y-cy)*(y-cy), k) = 1), c1 as (select k, avg(x) as cx, avg(y) as cy from a1 group by k), a2 as (select id, x, y, k from p cross join c1 qualify row_number() over (partition by id order by (x-cx)*(x-cx)+(y-cy)*(y-cy), k) = 1) select k, round(avg(x), 6) as cx, round(avg(y), 6) as cy, count(*) as n from a2 group by k")
def kmeans(t):
    points = t("orders").map("o_totalprice / 100000.0D as x", "cast(o_custkey % 7 as double) as y").df
    got = programs.k_means(points, ["x", "y"], [(1, 1), (2, 2), (3, 3), (4, 4)], 2)
    return points.sparkSession.createDataFrame([(k, *c, n) for k, c, n in got], "k int, cx double, cy double, n long").withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query("with d as (select l_quantity / 50.0 as x, l_extendedprice / 100000.0 as y from lineitem), w1 as (select 0.1 - 0.1 * avg(2 * x * (0.1 * x - y)) as w from d), w2 as (select (select w from w1) - 0.1 * avg(2 * x * ((select w from w1) * x - y)) as w from d) select round(w, 6) as w from w2")
def gradient_descent(t):
    rows = t("lineitem").map("l_quantity / 50.0D as x", "l_extendedprice / 100000.0D as y").df
    w = programs.descend(rows, ["x"], "y", [0.1], 0.1, 2)
    return rows.sparkSession.createDataFrame([(w[0],)], "w double").select(F.round("w", 6).alias("w"))


@query("select w, strlen(w) % 4 as topic, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \t\n]')) as w from documents) t where strlen(w) > 0 group by 1, 2")
def lda_counts(t):
    words = t("documents").flatmap(split(F.col("text")), "w").filter("octet_length(w) > 0").df
    return programs.lda_counts(words, (F.octet_length("w") % 4).cast("long"))


_points = "d as (select l_orderkey || '-' || l_linenumber as id, l_quantity / 50.0 as x, l_discount as z, l_extendedprice / 100000.0 as y from lineitem), c as (select count(*) as n from lineitem)"


def _lines(t) -> DataFrame:
    return t("lineitem").map("concat_ws('-', l_orderkey, l_linenumber) as id", "l_quantity / 50.0D as x", "l_discount as z", "l_extendedprice / 100000.0D as y").df


def _draw(share: str, seed: int, step: int, who: str) -> str:
    return f"('0x' || substr(md5('{seed}:{step}:{who}:' || id), 1, 8))::bigint < floor(4294967296 * least(1.0::double, {share}::double / (select n from c)))"


def _descent(steps: list[str]) -> str:
    """SQL of descent from (0.1, 0.1): each step is given as what it takes off, over d and the model m before it."""
    sql = f"with {_points}, m0 as (select 0.1::double as w0, 0.1::double as w1)"
    for i, off in enumerate(steps):
        sql += f", g{i} as ({off.format(m=f'm{i}')}), m{i + 1} as (select w0 - g0 as w0, w1 - g1 as w1 from m{i}, g{i})"
    return sql + f" select i, round(case when i = 0 then w0 else w1 end, 6) as w from m{len(steps)}, (values (0), (1)) v(i)"


def _gradient(step: int, who: str, seed: int, rate: str) -> str:
    residual = "(w0 * x + w1 * z - y)"
    return f"select {rate} * coalesce(avg(2 * x * {residual}), 0) as g0, {rate} * coalesce(avg(2 * z * {residual}), 0) as g1 from d, {{m}} where {_draw('1000', seed, step, who)}"


def _two(step: int, how: str) -> str:
    """Two workers' updates of one column, added up, or the greater one: of equal steps the greatest value is the last."""
    each = " union all ".join(_gradient(step, f"w{i}", 7, "0.1") for i in range(2))
    if how == "sum":
        return f"select sum(g0) as g0, sum(g1) as g1 from ({each})"
    return f"select g0, g1 from ({each}) order by g0 desc, g1 desc limit 1"


def _model(t, m) -> DataFrame:
    return t("region").df.sparkSession.createDataFrame([(j, float(m[j, 0])) for j in range(2)], "i int, w double").withColumn("w", F.round("w", 6))


@query(_descent([_gradient(s, "all", 7, "0.1") for s in range(3)]))
def sgd_minibatch(t):
    return _model(t, programs.sgd(_lines(t), ["x", "z"], ["y"], [[0.1], [0.1]], 0.1, 3, 1000, 7))


@query(_descent([_two(s + 1, "sum") for s in range(3)]))
def sgd_param(t):
    return _model(t, programs.sgd_param(_lines(t), ["x", "z"], ["y"], [[0.1], [0.1]], 0.1, 3, 1000, 7))


@query(_descent([_two(s + 1, "last") for s in range(3)]))
def sgd_peer_last(t):
    return _model(t, programs.sgd_peer(_lines(t), ["x", "z"], ["y"], [[0.1], [0.1]], 0.1, 3, 1000, 7, last=True))


@query(_descent([_two(s + 1, "sum") for s in range(3)]))
def sgd_peer_sum(t):
    return _model(t, programs.sgd_peer(_lines(t), ["x", "z"], ["y"], [[0.1], [0.1]], 0.1, 3, 1000, 7))


@query("select true as better")
def train_network(t):
    rows = t("supplier").map("s_suppkey as id", "(s_suppkey % 20) / 10.0D - 1 as x", "power((s_suppkey % 20) / 10.0D - 1, 2) as y").df
    loss = lambda layers: float(np.mean([(programs.forward(layers, np.array([[x]]))[-1][0, 0] - x * x) ** 2 for x in np.linspace(-1, 0.9, 20)]))
    before, after = (programs.train_network(rows, ["x"], ["y"], [4], 0.1, n, 1000) for n in (0, 6))
    return _row(t, loss(after) < loss(before), "better boolean")


@query("select w, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \t\n]')) as w from documents) t where strlen(w) > 0 group by 1")
def lda_gibbs(t):
    """Eight topics, one sweep over the whole vocabulary; the topics' counts of a word add up to the word's."""
    words = F.filter(split(F.col("text")), lambda w: F.octet_length(w) > 0)
    held, _ = programs.lda_blocks(t("documents").df.select(F.col("doc_id").alias("doc"), words.alias("words")), 8, 1)
    return gibbs.counts(partial(gibbs.each, held), 8).select("w", F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))


@query("select w, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \t\n]')) as w from documents) t where strlen(w) > 0 group by 1")
def lda_peer(t):
    """Four topics, one round among three peers; rows of the model that agree with the documents' topics."""
    words = F.filter(split(F.col("text")), lambda w: F.octet_length(w) > 0)
    over, store = programs.lda_peer_blocks(t("documents").df.select(F.col("doc_id").alias("doc"), words.alias("words")), 4, 1, 3)
    rows = gibbs.counts(over, 4).select("w", F.col("c").cast("array<double>").alias("by"))
    model = store.df.filter("k like 'w:%'").select(F.col("k").substr(F.lit(3), F.length("k")).alias("w"), "v")
    return rows.join(model, "w").filter("by = v").select("w", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).cast("long").alias("n"))


@query("select l_orderkey, l_linenumber from lineitem where ('0x' || substr(md5('11:' || l_orderkey || ':' || l_linenumber), 1, 8))::bigint < 429496729")
def sample(t):
    return t("lineitem").map("l_orderkey", "l_linenumber").sample(0.1, 11, ["l_orderkey", "l_linenumber"])


@query("select true as near")
def sample_rows(t):
    rows = t("lineitem").map("l_orderkey", "l_linenumber")
    n, all_ = rows.sample(0.1, 11).count(), rows.count()
    return _row(t, abs(n - 0.1 * all_) < 5 * (0.09 * all_) ** 0.5, "near boolean")


@query("select count(*) as n from orders")
def bounded_count(t):
    return _row(t, t("orders").map("o_orderkey").bounded_count(600_000), "n long")


@query("select count(*) as n, count(distinct n_name) as d from nation")
def collect_nested(t):
    parts = t("nation").map("n_name").collect()
    names = [r[0] for p in parts for r in p]
    return t("region").df.sparkSession.createDataFrame([(sum(len(p) for p in parts), len(set(names)))], "n long, d long")


@query("select true as some, true as me")
def workers(t):
    from parflow.context import Context

    context = Context(t("region").df.sparkSession)
    return context.spark.createDataFrame([(len(context.workers()) >= 1, bool(context.myself()))], "some boolean, me boolean")


def _saved(t, scheme: str):
    import uuid

    from parflow.sources import io

    d = t("region").map("r_regionkey", "r_name")
    spark = d.df.sparkSession
    url = f"{scheme}://{io.shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    return spark, io.save(d, url), url


@query("select r_regionkey, r_name, true as written from region")
def save_bytes(t):
    from parflow.sources import io

    _, size, url = _saved(t, "parquet")
    return io.load(t("region").df.sparkSession, url).df.withColumn("written", F.lit(size > 0))


@query("select r_regionkey || ',' || r_name as value from region")
def load(t):
    from parflow.sources import io

    spark, _, url = _saved(t, "text")
    return io.load(spark, url)


@query("select 48000000.0::double as s")
def ndarray_ops(t):
    a = programs.NdArray.ones(t("region").df.sparkSession, (200, 300, 400)).map(lambda v: v + 1)
    return a.df.agg(F.sum("value").alias("s"))
