import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parflow.algos import gibbs, programs
from parflow.operators.dataset import Dataset
from parflow.plans import barriers, params, ring
from parflow.plans.barriers import Progress
from parflow.streaming.pushes import push_stream


def test_barriers():
    p = [Progress("a", 0), Progress("b", 0)]
    assert barriers.bsp(0, p) == (1, ["a", "b"])
    p = [Progress("a", 2), Progress("b", 0, True)]
    assert barriers.bsp(1, p) == (1, [])
    assert barriers.ssp(1, p, 1) == (1, [])
    assert barriers.ssp(1, p, 2) == (1, ["a"])
    assert barriers.asp(1, p) == (1, ["a"])
    assert barriers.p2p_bsp(2, [2, 3], True) and not barriers.p2p_bsp(2, [1], True) and not barriers.p2p_bsp(2, [2], False)
    assert set(barriers.psp(0, p, 2, 1)[1]) <= {"a"}


def test_ahead_workers_do_not_stop_the_others():
    p = [Progress("a", 2), Progress("b", 1)]
    assert barriers.ssp(1, p) == (2, ["a", "b"]) and barriers.bsp(2, p) == (2, [])


def test_barriers_as_tables(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 3, 1), ("c", 2, 0)], "worker string, step long, busy int")
    ps = [Progress(r["worker"], r["step"], bool(r["busy"])) for r in rows.collect()]
    for step in range(5):
        for rule, f in (("bsp", barriers.bsp), ("ssp", barriers.ssp), ("asp", barriers.asp)):
            t, go = f(step, ps)
            assert sorted(map(tuple, barriers.admitted(rows, rule, step).collect())) == [(w, t) for w in sorted(go)]
    assert barriers.admitted(rows.limit(0), "bsp", 1).count() == 0
    peers = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 2, True)], "peer string, step long, blocked boolean")
    names = lambda rule: sorted(r[0] for r in barriers.p2p_admitted(peers, rule).collect())
    assert (names("bsp"), names("asp"), names("asp_local")) == (["a"], ["a", "b", "c"], ["a", "c"])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=8), st.integers(0, 5), st.integers(1, 4))
def test_ssp_against_its_rule(rows, step, stale):
    ps = [Progress(str(i), s, b) for i, (s, b) in enumerate(rows)]
    t = step + 1 if all(s >= step for s, _ in rows) else step
    assert barriers.ssp(step, ps, stale) == (t, [str(i) for i, (s, b) in enumerate(rows) if not b and s - t < stale])


def test_ring(spark):
    nodes = {f"n{i}": ring.ring_hash(i * 7919 + 3) for i in range(9)}
    df = spark.range(200).withColumn("h", ring.ring_hash(F.col("id")))
    got = df.select("id", ring.owner(F.col("h"), nodes).alias("near"), ring.owner(F.col("h"), nodes, True).alias("far")).collect()
    for r in got:
        h = ring.ring_hash(r["id"])
        assert (r["near"], r["far"]) == (ring.nearest(h, nodes), ring.furthest(h, nodes))
    assert ring.nearest(5, {"a": 5}, ("a",)) == ""
    many = {f"n{i}": ring.ring_hash(i * 7919 + 3) for i in range(ring.PLAN_NODES + 9)}
    for r in df.select("h", ring.owner(F.col("h"), many).alias("near"), ring.owner(F.col("h"), many, True).alias("far")).limit(40).collect():
        assert (r["near"], r["far"]) == (ring.nearest(r["h"], many), ring.furthest(r["h"], many))


def test_store(spark):
    s = params.Store.empty(spark)
    with pytest.raises(KeyError):
        s.get(1)
    s.set(1, 2.5, 3)
    s.set(1, 1.5, 2)
    assert s.get(1) == (1.5, 2) and s.keys().count() == 1
    rows = spark.createDataFrame([(1, 9.0, 1, 0), (1, 8.0, 0, 1)], "k long, v double, t long, o long")
    s.upsert(rows, "o")
    assert s.get(1)[0] == 8.0
    s.upsert(rows)
    assert s.keys().count() == 1  # keys stay unique, whatever comes in


def test_store_beyond_few_rows(spark, monkeypatch):
    monkeypatch.setattr(params, "FEW_ROWS", 10)
    s = params.Store(spark.range(30).selectExpr("id as k", "1.0D as v", "0L as t"))
    for i in range(3):
        s.upsert(s.df.select("k", (F.col("v") * 2).alias("v"), (F.col("t") + 1).alias("t")))
        assert len(s.df._jdf.queryExecution().analyzed().toString().splitlines()) < 4
    assert {tuple(r)[1:] for r in s.df.collect()} == {(8.0, 3)} and s.df.count() == 30


@pytest.mark.parametrize("barrier", ["bsp", "ssp", "asp"])
def test_param_server(spark, barrier):
    ps = params.ParamServer(params.Store(spark.createDataFrame([(k, 10.0, 0) for k in range(4)], "k long, v double, t long")), ["a", "b"], barrier)
    ps.register_schedule(lambda workers, store: store.select(F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("worker"), "k", "v"))
    ps.register_push(lambda f: pd.DataFrame({"k": f.k, "v": 1.0}))
    ps.register_pull(params.subtract)
    ps.register_stop(lambda s: s.step >= 2)
    ps.start(5)
    assert {r["k"]: r["v"] for r in ps.store.df.collect()} == {k: 8.0 for k in range(4)}
    assert ps.worker_num() == 2 and sorted(r["k"] for r in ps.keys().collect()) == [0, 1, 2, 3]


def test_plan_stays_short(spark):
    ps = params.ParamServer(params.Store(spark.createDataFrame([(k, 1024.0, 0) for k in range(4)], "k long, v double, t long")), ["a", "b"], "ssp", lambda w, n: w == "a" or n % 2 == 0)
    lengths, lead = [], []
    ps.register_schedule(lambda go, store: store.select(F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("worker"), "k", "v"))
    ps.register_push(lambda f: pd.DataFrame({"k": f.k, "v": 1.0}))
    ps.register_pull(params.subtract)

    def stop(server):
        lengths.append(len(server.store.df._jdf.queryExecution().analyzed().toString().splitlines()))
        lead.append(server.progress["a"] - server.progress["b"])
        return False

    ps.register_stop(stop)
    ps.start(12)
    assert max(lengths) <= 3 and max(lead) == 2  # ahead by as much as the rule allows: one step past the one that is awaited
    assert {r["k"]: r["v"] for r in ps.store.df.collect()} == {k: 1024.0 - ps.progress["ab"[k % 2]] for k in range(4)}


def test_peers_see_a_snapshot(spark):
    nodes = {"p": ring.ring_hash(1), "q": ring.ring_hash(2)}
    sw = params.PeerSwarm(params.Store(spark.createDataFrame([(k, 1.0, 0) for k in range(3)], "k long, v double, t long")), nodes)
    sw.register_schedule(lambda s, go: s.owners().select(F.col("owner").alias("peer"), "k"))
    sw.register_push(lambda f: pd.DataFrame({"k": f.k, "v": f.v}))
    sw.register_pull(params.subtract)
    sw.start(1)
    assert [r["v"] for r in sw.store.df.collect()] == [0.0] * 3
    sw.set(7, 2.0)
    assert sw.get(7) == (2.0, 1) and sw.swarm_size() == 2 and sw.is_server()
    sw.join("r", ring.ring_hash(7))
    assert {r["k"]: r["owner"] for r in sw.owners().collect()}[7] == "r"


def test_updates_wait_for_the_barrier(spark):
    nodes = {"p": ring.ring_hash(1), "q": ring.ring_hash(2)}
    sw = params.PeerSwarm(params.Store(spark.createDataFrame([(k, 8.0, 0) for k in (1, 2)], "k long, v double, t long")), nodes, barriers.p2p_bsp, lambda p, n: p == "p" or n == 3)
    sw.register_schedule(lambda s, go: s.owners().select(F.col("owner").alias("peer"), "k"))
    sw.register_push(lambda f: pd.DataFrame({"k": f.k, "v": 1.0}))
    sw.register_pull(params.subtract)
    sw.start(2)
    assert sw.steps == {"p": 1, "q": 0} and sw.get(1)[0] == 8.0  # kept, not lost
    sw.start(1)
    assert sw.steps == {"p": 1, "q": 1} and (sw.get(1)[0], sw.get(2)[0]) == (7.0, 7.0)


def test_merges(spark):
    store = spark.createDataFrame([(1, 10.0, 0)], "k long, v double, t long")
    up = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 3)], "k long, v double, t long")
    assert tuple(params.subtract(up, store).first()) == (1, 7.0, 3)
    assert tuple(params.subtract_last(up, store).first()) == (1, 8.0, 3)


def test_word_count(spark):
    d = Dataset(spark.createDataFrame([("The Map map\tof É e\n- fold",)], "value string"))
    assert dict(map(tuple, programs.word_count(d).collect())) == {"map": 2, "É": 1, "e": 1, "fold": 1}


def test_k_means_drops_empty_clusters(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (0.2, 0.0), (9.0, 9.0)], "x double, y double")
    got = programs.k_means(pts, ["x", "y"], [(0, 0), (9, 9), (50, 50)], 3)
    assert [(k, n) for k, _, n in got] == [(0, 2), (1, 1)] and got[0][1] == pytest.approx([0.1, 0.0])


def test_gradient_descent(spark):
    r = np.random.default_rng(0)
    x = r.random((300, 3))
    y = x @ np.array([[0.3, 0.5], [0.7, 0.4], [0.9, 0.2]])
    rows = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], "a double, b double, c double, p double, q double")
    w = programs.descend(rows, ["a", "b", "c"], "p", [0.1] * 3, 0.5, 30)
    assert np.abs(x @ np.array(w) - y[:, 0]).mean() < 0.1
    start = np.full((3, 2), 0.1)
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    loss = lambda m: ((x @ m - y) ** 2).mean()
    assert loss(programs.sgd(rows, ["a", "b", "c"], ["p", "q"], start, 0.3, 12, 50, 1)) < loss(start)


def test_descent_on_the_engines(spark):
    r = np.random.default_rng(0)
    x = r.random((400, 3))
    y = x @ np.array([[0.3, 0.5], [0.7, 0.4], [0.9, 0.2]])
    rows = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, p double, q double").coalesce(2)
    start = np.full((3, 2), 0.1)
    loss = lambda m: ((x @ m - y) ** 2).mean()
    assert loss(programs.sgd_param(rows, ["a", "b", "c"], ["p", "q"], start, 0.2, 30, 10, 1, workers=4)) < 0.3 * loss(start)
    assert loss(programs.sgd_param(rows, ["a", "b", "c"], ["p", "q"], start, 0.2, 12, 10, 1, workers=4, barrier="ssp", finishes=lambda w, n: w != "w0" or n % 3 == 0)) < 0.7 * loss(start)
    for last in (False, True):
        assert loss(programs.sgd_peer(rows, ["a", "b", "c"], ["p", "q"], start, 0.2, 12, 10, 1, 3, last)) < 0.7 * loss(start)


def test_network_gradients():
    r = np.random.default_rng(3)
    layers, x, y = [r.normal(size=(4, 5)), r.normal(size=(6, 2))], r.normal(size=(7, 3)), r.normal(size=(7, 2))
    loss = lambda: ((programs.forward(layers, x)[-1] - y) ** 2).sum() / len(x)
    for layer, g in zip(layers, programs.gradients(layers, x, y)):
        for at in np.ndindex(layer.shape):
            layer[at] += 1e-6
            up = loss()
            layer[at] -= 2e-6
            down = loss()
            layer[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_lda(spark):
    docs = spark.createDataFrame([(d, [str((d % 2) * 5 + int(w)) for w in np.random.default_rng(d).integers(0, 5, 20)]) for d in range(10)], "doc long, words array<string>")
    state, curve = programs.lda(docs, 2, 6, alpha=1.0)
    rows = state.collect()
    assert len(rows) == 10 and all(len(r["z"]) == 20 and set(r["z"]) <= {0, 1} for r in rows)
    assert curve[-1] > curve[0]


@pytest.mark.parametrize("head", [0, 30])
def test_lda_against_its_rule(spark, monkeypatch, head):
    """Token after token, as the sampler says, with blocks, chunks and rows sent to all so small that there are several."""
    monkeypatch.setattr(gibbs, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(gibbs, "CHUNK", 60)
    monkeypatch.setattr(gibbs, "HEAD", head)
    r = np.random.default_rng(5)
    docs = [(d, [str(int(w)) for w in r.zipf(1.5, int(n)) % 30]) for d, n in enumerate([0, 1, 90, 7, 7, 25, 3, 12])] + [(None, ["a", "1", None, "a"]), (3, ["1", "b"]), (99, None)]
    state, curve = programs.lda(spark.createDataFrame(docs, "doc long, words array<string>").coalesce(2), 3, 2, 4, 1.0)
    docs = [(-1 if d is None else d, [w for w in ws or [] if w is not None]) for d, ws in docs]
    zs, rng = [], lambda *key: np.random.default_rng([*key[:-1], key[-1] & 0xFFFFFFFF])
    for d, ws in docs:
        zs.append(rng(4, d).integers(0, 3, len(ws)))
    for sweep in (1, 2):
        table, ll = {w: np.zeros(3) for _, ws in docs for w in ws}, 0.0
        for (_, ws), z in zip(docs, zs):
            for w, k in zip(ws, z):
                table[w][k] += 1
        n_k = sum(table.values())
        for (d, ws), z in zip(docs, zs):
            u, n_d, own, of = rng(4, sweep, d).random(len(ws)), np.bincount(z, minlength=3).astype(float), n_k.copy(), {w: table[w].copy() for w in ws}
            for i, w in enumerate(ws):
                for x in (n_d, own, of[w]):
                    x[z[i]] -= 1
                p = np.cumsum((n_d + 1 / 3) * (of[w] + 0.1) / (own + len(table) * 0.1))
                ll += np.log(p[-1] / (len(ws) - 1 + 1.0))
                z[i] = np.searchsorted(p, u[i] * p[-1], "right")
                for x in (n_d, own, of[w]):
                    x[z[i]] += 1
        assert curve[sweep - 1] == pytest.approx(ll / sum(map(len, zs)))
    key = lambda x: (x[0], len(x[1]))
    assert sorted(((-1 if r["doc"] is None else r["doc"], r["words"], r["z"]) for r in state.collect()), key=key) == sorted(((d, ws, z.tolist()) for (d, ws), z in zip(docs, zs)), key=key)


def test_lda_among_peers(spark):
    docs = spark.createDataFrame([(d, [f"w{(d % 2) * 5 + int(w)}" for w in np.random.default_rng(d).integers(0, 5, 20)]) for d in range(12)] + [(99, [])], "doc long, words array<string>")
    state, store = programs.lda_peer(docs, 2, 4, 3, share=0.6, alpha=1.0, acts=lambda p, n: p != "p0" or n % 2 == 0)
    got = {r["k"]: r["v"] for r in store.df.collect()}
    want = {}
    for r in state.collect():
        assert len(r["z"]) == len(r["words"]) and set(r["z"]) <= {0, 1}
        for w, z in zip(r["words"], r["z"]):
            want.setdefault(f"w:{w}", [0, 0])[z] += 1
    assert {k: v for k, v in got.items() if k[0] == "w"} == want and got["n"] == np.sum(list(want.values()), 0).tolist()
    assert sum(got["n"]) == 240 and got["d:99"] == []


def test_lda_among_peers_in_blocks(spark, monkeypatch):
    """Many blocks a peer, nothing counted twice or computed for a few rows first; words of one block alone, nulls."""
    monkeypatch.setattr(gibbs, "BLOCK_TOKENS", 60)
    docs = [(d, [f"w{int(w)}" for w in np.random.default_rng(d).integers(0, 9, 20)] + [f"own{d}"]) for d in range(30)] + [(98, None), (None, ["w1"])]
    over, store = programs.lda_peer_blocks(spark.createDataFrame(docs, "doc long, words array<string>").coalesce(2), 3, 3, 2, share=0.5, alpha=1.0)
    state = over(gibbs.documents, "doc long, words array<string>, z array<int>").collect()
    assert sorted((r["doc"], r["words"]) for r in state) == [(d, w or []) for d, w in docs[:-1]]
    got, by_block = ({r["w"]: r["c"] for r in f.collect()} for f in (store.df.filter("k like 'w:%'").selectExpr("substr(k, 3) as w", "cast(v as array<long>) as c"), gibbs.counts(over, 3)))
    assert got == by_block and sum(map(sum, got.values())) == 630 and not store.small


def test_ndarray(spark):
    a = programs.NdArray.ones(spark, (2, 3, 4))
    b = a.map(lambda v: v + 1)
    assert b.sum() == 48 == b.fold(lambda x, y: x + y, 0.0, F.sum("value"))
    assert b.add(a).set((1, 2, 3), 7).get((1, 2, 3)) == 7 and b.to_ndarray().shape == (2, 3, 4)
    u = programs.NdArray.uniform(spark, (50,), 1).to_ndarray()
    assert 0 <= u.min() and u.max() < 1 and len(set(u)) == 50


def test_pushes_from_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (2, 1.0, 1)], "k long, v double, t long")
    rows.write.parquet(f"{tmp_path}/in")
    store = params.Store.empty(spark)
    push_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp").awaitTermination(60)
    assert {r["k"]: r["v"] for r in store.df.collect()} == {1: 6.0, 2: 1.0}
