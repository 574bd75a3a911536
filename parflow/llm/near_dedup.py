"""Operator 6: near-duplicates by MinHash with odd sketches.

1. Each text gives its shingle set, a key of the whole set, ``BANDS`` x ``ROWS`` MinHash samples, and an odd sketch: every
   sample flips one bit of a bitmap, so the bits in which two bitmaps differ are an even-or-odd count of the samples in which
   the sets differ, and their number estimates the similarity, most precisely when it is high.
2. Texts with one set are one class, named by its smallest doc_id; only classes go on. A group of any number of copies is one row.
3. Classes that agree in all rows of a band meet in a bucket; those alone in theirs are screened out before members are
   shuffled, and so are texts that no pair needs. First each bucket links its members to a centre (a star, one row
   a member; centres differ between bands), pairs are dropped whose sketches put the similarity far below the threshold, and
   the rest are confirmed on the full sets.
4. Where a bucket's members are not yet in one component, all its pairs across components are compared by sketch and size
   within the join, and what remains is confirmed likewise: stars only save work, no pair of a bucket is left out.
5. Components of the confirmed links; every class member gets its class's component.

A pair at the threshold misses all buckets with probability (1 - t**ROWS)**BANDS: 1e-9 at 0.85, 3e-7 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise, own_name, screen, slices
from .components import components
from .shingles import common, forget, mix64, shingle_set

BANDS, ROWS = 28, 4
#: Words of 64 bits in an odd sketch.
SKETCH = 8
#: A pair whose sketches put it so far below the threshold is dropped. A pair at the threshold is lost with probability 4e-12 at
#: 0.85 and 6e-10 at 0.8.
MARGIN = 0.3
CENTRES = 3
#: Texts on either side of a cell in which pairs are confirmed.
CELL = 64
_rng = np.random.default_rng(20)
FACTORS = (_rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
MASKS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash samples of one set, as 32-bit hashes."""
    h = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        np.minimum(out, np.min((part[None, :] ^ MASKS[:, None]) * FACTORS[:, None], axis=1), out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.astype(np.uint64).reshape(BANDS, ROWS)
    k = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        k = mix64(k ^ x[:, j])
    return k.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as ``SKETCH`` 64-bit integers."""
    bit = mix64(sig.astype(np.uint64) ^ SEEDS) % np.uint64(64 * SKETCH)
    parity = (np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_bits(similarity: float) -> int:
    """Differing bits that a pair of this similarity is expected to have: n/2 (1 - exp(-2 k d / n)) with d samples that differ, two flips each."""
    n, k = 64 * SKETCH, BANDS * ROWS
    return int(np.ceil(n / 2 * (1 - np.exp(-4 * k * (1 - similarity) / n))))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch); the last three null without words."""
    names = ["doc_id", "n_shingles", "set_key", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, key, bands, sketch = [], [], [], []
                for t in part.column("text"):
                    s = shingle_set(t.as_py())
                    n.append(len(s))
                    if len(s):
                        sig = signature(s)
                        key.append(xxhash.xxh3_128_digest(s.tobytes()))
                        bands.append(band_keys(sig))
                        sketch.append(odd_sketch(sig))
                    else:
                        key.append(None), bands.append(None), sketch.append(None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names)
        forget()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def close(percent: int, a: str, b: str):
    """By size and sketch, the pair may be at the threshold."""
    sizes = (F.least(f"{a}.n", f"{b}.n") * 100) >= (F.greatest(f"{a}.n", f"{b}.n") * percent)
    bits = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0])))
    return sizes & (bits <= most_bits(percent / 100 - MARGIN))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Pairs of one neighbourhood (named by the smallest neighbour of a) are dealt into cells by the hashes of a and b, so that a
    cell has about ``CELL`` texts on either side. A text goes once to each of its cells rather than once to each of its pairs.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c"))
    pairs = pairs.join(near, "a")
    nodes = pairs.select("c", "a").unionByName(pairs.select("c", F.col("b").alias("a"))).distinct().groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("blocks"))
    block = lambda x: F.pmod(F.xxhash64(x), F.col("blocks"))
    cells = materialise(pairs.join(nodes, "c").select("c", block("a").alias("x"), block("b").alias("y"), "a", "b"), "cells")
    wanted = cells.select("c", "x", "y", F.col("a").alias("doc_id")).unionByName(cells.select("c", "x", "y", F.col("b").alias("doc_id"))).distinct()
    texts = screen(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), "doc_id", wanted.select("doc_id").distinct()).join(wanted, "doc_id").select(F.col("c").alias("tc"), F.col("x").alias("tx"), F.col("y").alias("ty"), "doc_id", "text")

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for d, t in zip(texts.column("doc_id").to_pylist(), texts.column("text")):
            sets.setdefault(d, []).append(shingle_set(t.as_py()))
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            for p in sets.get(a, []):
                if any(100 * (both := common(p, q)) >= percent * (len(p) + len(q) - both) > 0 for q in sets.get(b, [])):
                    out.append((a, b))
                    break
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    found = cells.groupBy("c", "x", "y").cogroup(texts.groupBy("tc", "tx", "ty")).applyInArrow(run, "a long, b long")
    found = materialise(found, "confirmed")
    delete(cells)
    return found


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Needs doc_id and text; no other column is looked at. A text without words has no shingles, links with nothing and is kept.
    A null doc_id cannot name a component: its row is unlinked, with component_id null, and kept. Rows of one doc_id are one
    node, linked by whatever any of their texts links. An empty table gives an empty one.
    """
    all_rows = materialise(sketches(docs), "sketches")
    named = all_rows.filter("doc_id is not null and set_key is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    # a doc_id with several texts ties its classes together
    ties = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    ties = named.join(ties, "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    # most band keys have one member: they are screened out before members are shuffled
    slots = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    keys = materialise(slots.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key"), "keys")
    slots = materialise(screen(slots, "key", keys).join(keys, "key", "left_semi"), "slots")
    centre = F.min(F.struct(F.xxhash64("rep", F.col("band") % CENTRES), "rep"))["rep"]
    centres = slots.groupBy("key", "band").agg(centre.alias("centre")).select("key", "centre")
    stars = slots.select("key", "rep").join(centres, "key").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    side = lambda x: classes.select(F.col("rep").alias(x), "n", "sketch").alias(f"c{x}")
    stars = materialise(stars.join(side("a"), "a").join(side("b"), "b").filter(close(percent, "ca", "cb")).select("a", "b"), "stars")
    links = materialise(confirm(stars, docs, percent).unionByName(ties), "links")
    found = materialise(components(links), "components")

    at = F.coalesce("component", "rep")
    homes = materialise(slots.select("key", "rep").join(found, slots["rep"] == found["node"], "left").select("key", "rep", at.alias("home")), "homes")
    open_keys = homes.groupBy("key").agg(F.min("home").alias("x"), F.max("home").alias("y")).filter("x <> y").select("key")
    rest = homes.join(open_keys, "key", "left_semi").join(classes.select("rep", "n", "sketch"), "rep")
    rest = materialise(rest, "open")
    x, y = rest.alias("x"), rest.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.home") != F.col("y.home")) & close(percent, "x", "y"))
    pairs = materialise(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "pairs")
    delete(keys, slots, stars, homes, rest)
    if not pairs.isEmpty():
        more = materialise(links.unionByName(confirm(pairs, docs, percent)), "links")
        delete(links, found)
        links, found = more, materialise(components(more), "components")
    delete(pairs, links)
    homes = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", at.alias("home"))
    # rows without a class get keys of their own, so that no task has all of them
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("set_key")), F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.uuid())).cast("binary"))
    out = all_rows.select("doc_id", "n_shingles", own.alias("set_key")).join(homes, "set_key", "left")
    component = F.coalesce("home", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: its smallest doc_id, one row of it (the one with the smallest text); rows with a
    null doc_id stay.

    Only rows that may have to go are shuffled: those of ids that do, and of ids with several rows.
    """
    groups = near_duplicates(docs, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    touched = materialise(groups.filter("not kept or rows > 1").select(F.col("doc_id").alias("touched"), "kept"), "touched")
    pure = screen(docs, "doc_id", touched, inside=False)
    maybe = screen(docs, "doc_id", touched)
    names = [own_name(docs, x) for x in ("touched", "kept")]
    rows = maybe.join(touched.toDF(*names), maybe["doc_id"].cast("long") == F.col(names[0]), "left")
    untouched = rows.filter(F.col(names[0]).isNull()).select(*docs.columns)
    row = F.struct(*(maybe[c] for c in docs.columns))
    once = rows.filter(F.col(names[1])).groupBy(names[0]).agg(F.min_by(row, F.struct("text", F.xxhash64(*(maybe[c] for c in docs.columns)))).alias("row"))
    once = once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return pure.unionByName(untouched).unionByName(once)


#: The query in DuckDB SQL: every pair of documents that share a shingle is compared on full sets, then links are followed.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from d),
n as (select doc_id, len(s)::bigint as n from s),
u as (select doc_id, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id, n.doc_id = least(n.doc_id, coalesce(min(r.b), n.doc_id)) as kept
from n left join r on r.a = n.doc_id group by 1, 2
"""
