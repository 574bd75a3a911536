"""Operator 1: mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source is expected ``rate = target / source_size`` times (3 at most). Documents of a source are put in
order of size, then id; the expected copies are summed along that order, one offset drawn for the source is added, and a
document is taken once for each integer between the sum before it and the sum with it. As neighbours in the order are equally
long, the words taken come near the target.

The prefix sum never orders a source in one task. Copies expected are equal within a source, so a document's sum is its rank
times the rate, and ranks come from three counts: documents in shorter sizes (a window over distinct sizes, bounded by the
longest text), in earlier blocks of ids of the same size (and blocks of blocks, so ids may lie as they like), and a row number
within one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, own_name

#: A block of the ranking has 2**BITS ids, a block of blocks as many blocks, and so on; no window sorts more distinct ones.
BITS = 16
#: No document is taken more often.
MOST = 3


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """Add ``target`` to rows (source, source_size), one a source.

    Sources by code point, null last, have the ``weights`` in turn. ``share`` of all sizes is dealt by weight; where a target
    would be above ``MOST`` times its source, it stops there and the excess is dealt again among the others, until none is
    above. That fixed point is found in one pass: by rising ratio of limit to weight, a source is limited if its limit is
    below its part of what the limited ones before it leave. The windows hold a row for each source, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("long"))
    every = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    big = lambda c: c.cast("decimal(38,0)")
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)).alias("caps"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("ws"),
    )
    budget = F.floor(F.col("all_size") * F.lit(share)) if share != 1.0 else F.col("all_size")
    rows = rows.withColumn("budget", budget)
    limited = big(MOST * F.col("source_size")) * (F.col("all_w") - F.col("ws")) < big(F.col("budget") - F.col("caps")) * F.col("w")
    level = (F.col("budget") - F.col("caps")).cast("double") / (F.col("all_w") - F.col("ws")).cast("double")
    rows = rows.withColumn("limited", limited)
    rows = rows.withColumn("level", F.min_by(F.when(~F.col("limited"), level), F.when(~F.col("limited"), F.col("source_size") / F.col("w"))).over(whole))
    free = F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))
    cap = (MOST * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", F.when(F.col("limited"), cap).otherwise(F.least(cap, free)).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1): 20 bits of a digest of seed and name, so reruns agree."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, copies, taken).

    Needs doc_id, text and source; other columns are not looked at, so names cannot clash. A null or empty text has size 0
    and takes 0 words; a null source is a source of its own, the last; a null doc_id ranks before others of its size; repeated
    rows are ranked as rows of their own. An empty table gives an empty one.
    """
    # rows without an id are spread by their text; without a text too they are alike, so it does not matter which is where
    nobody = F.pmod(F.when(F.col("text").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text")), F.lit(4096))
    block = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BITS), -1 - nobody - F.lit(1 << 52))
    base = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), block.alias("block")), "mix")
    key = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")]
    base = base.select("*", *key)
    cells = base.groupBy("s", "none", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("s", "none", "size").agg(F.sum("n").alias("n"))
    goal = targets(by_size.groupBy("s", "none").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")).select(F.when(~F.col("none"), F.col("s")).alias("source"), "source_size"), weights, share)
    goal = goal.select("source_size", "target", *key, offset(F.col("source"), seed).alias("u"))
    upto = lambda by, over: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(over).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shorter = by_size.select("s", "none", "size", upto(["s", "none"], "size").alias("shorter")).join(goal, ["s", "none"])
    # earlier blocks, counted by blocks of blocks, so that no window has more than 2**BITS rows however ids lie
    level = lambda k: F.shiftright("block", k * BITS).alias(f"b{k}")
    wide = cells.groupBy("s", "none", "size", level(1), level(2)).agg(F.sum("n").alias("n"))
    wider = wide.groupBy("s", "none", "size", "b2").agg(F.sum("n").alias("n"))
    wider = wider.select("s", "none", "size", "b2", upto(["s", "none", "size"], "b2").alias("e2"))
    wide = wide.select("s", "none", "size", "b1", "b2", upto(["s", "none", "size", "b2"], "b1").alias("e1"))
    cells = cells.select("s", "none", "size", "block", level(1), level(2), F.col("n"))
    cells = cells.select("s", "none", "size", "block", "b1", "b2", upto(["s", "none", "size", "b1"], "block").alias("e0"))
    cells = cells.join(wide, ["s", "none", "size", "b1", "b2"]).join(wider, ["s", "none", "size", "b2"])
    cells = cells.select("s", "none", "size", "block", (F.col("e0") + F.col("e1") + F.col("e2")).alias("earlier")).join(shorter, ["s", "none", "size"])
    place = F.row_number().over(Window.partitionBy("s", "none", "size", "block").orderBy(F.col("doc_id")))
    ranked = base.withColumn("place", place).join(cells, ["s", "none", "size", "block"])
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rank = (F.col("shorter") + F.col("earlier") + F.col("place")).cast("double")
    copies = (F.floor(rank * rate + F.col("u")) - F.floor((rank - 1) * rate + F.col("u"))).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, all columns kept.

    Copies are joined back by (doc_id, source, size). Rows that agree in all three share the copies of the group, each within
    one of the same number.
    """
    names = {x: own_name(docs, f"mix_{x}") for x in ("id", "s", "none", "size", "n", "c", "i", "copies", "copy")}
    key = [names[x] for x in ("id", "s", "none", "size")]
    col = lambda x: F.col(names[x])
    named = lambda df, size: df.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias(names["id"]), F.coalesce(F.col("source").cast("string"), F.lit("")).alias(names["s"]), F.col("source").isNull().alias(names["none"]), size.alias(names["size"]))
    taken = named(mix(docs, seed, weights, share), F.col("size")).groupBy(*key).agg(F.count(F.lit(1)).alias(names["n"]), F.sum("copies").alias(names["c"])).filter(col("c") > 0)
    rows = named(docs, words(F.col("text"))).join(taken, key)
    i = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))
    rows = rows.withColumn(names["i"], i)
    own = F.floor(col("c") * col("i") / col("n")) - F.floor(col("c") * (col("i") - 1) / col("n"))
    rows = rows.withColumn(names["copies"], own.cast("int")).filter(col("copies") > 0)
    return rows.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), col("copies")))).select(*docs.columns)


def oracle() -> str:
    """The query in DuckDB SQL."""
    return r"""
with base as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
src as (select source, sum(size)::bigint as source_size from base group by 1),
w as (select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as w from src),
o as (select *, sum(source_size) over () as all_size, sum(w) over () as all_w,
  coalesce(sum(3 * source_size) over (order by source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as caps,
  coalesce(sum(w) over (order by source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as ws from w),
l as (select *, 3 * source_size * (all_w - ws) < (all_size - caps) * w as limited, (all_size - caps)::double / (all_w - ws)::double as lv from o),
t as (select source, source_size, case when limited then (3 * source_size)::double else least((3 * source_size)::double, coalesce((select arg_min(lv, source_size / w) from l where not limited) * w, 0.0)) end as target from l),
r as (select doc_id, b.source, size, row_number() over (partition by b.source order by size, doc_id)::double as rank, source_size, target,
  case when source_size > 0 then least(3.0::double, target / source_size) else 0.0 end as rate,
  ('0x' || substr(md5('17:' || coalesce('=' || b.source, 'null')), 1, 5))::bigint::double / 1048576.0::double as u
  from base b join t on b.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(rank * rate + u) - floor((rank - 1) * rate + u))::bigint * size)::bigint as taken from r"""
