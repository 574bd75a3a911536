"""Operator 9: benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a window of words and ignores the others. The kept words of every window of every benchmark
item are hashed under each mask, and so are those of every document; an item's windows are also hashed as they would read with
one word left out or put in. Where hashes meet, stretches of the item are aligned with the document round that place, and errors
are counted: words substituted, left out or put in. An item is found where

- the whole item, or any ``STRETCH`` words of it in a row, have at most 100 - ``percent`` % errors, or
- any ``RUN`` words of it in a row stand unchanged.

So a long enough part of an item counts like the whole. An item of fewer than five words is found where it is a whole line of a
text, or the whole text. The seeds meet every such place of five words or more (words left out
or put in between two pieces join them, if the pieces have four words together; a test tries all sets of errors).

The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents each, so what is
sent is bounded however large the benchmark is. Documents are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .shingles import ODD, mix64

#: Positions kept.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 4, 5), (0, 1, 3, 6))
#: Masks as items are hashed: (number of the mask it is compared under, positions). Beyond the masks themselves, four words in a
#: row of the document may be such as have one more word between them in the item, and the other way round.
ITEM_MASKS = (*enumerate(MASKS), *((0, MASKS[g]) for g in (1, 2, 3)), *((g, MASKS[0]) for g in (1, 2, 3)))
#: Words in a row of an item that are enough: with some errors, and without any.
STRETCH, RUN = 40, 25
#: Shorter items count where they are a whole line or a whole text: a few common words inside others are no leak.
LEAST_WORDS = 5
BLOCK_WORDS = 1_000_000
#: The filter of seeds has eight places for each, 2**25 (32 MB) at most.
FILTER_BITS = 25
_drop = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_table = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _drop)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case, and of bytes beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_table).split()


def seeds(codes: np.ndarray, masks: tuple = tuple(enumerate(MASKS))) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: places where all kept words have codes, and their hashes."""
    for m, mask in masks:
        k = len(codes) - mask[-1]
        if k <= 0:
            continue
        ok = codes[:k] >= 0
        for o in mask[1:]:
            ok &= codes[o : o + k] >= 0
        at = np.flatnonzero(ok)
        h = np.full(len(at), np.uint64(m + 1))
        for j, o in enumerate(mask):
            h += codes[at + o].astype(np.uint64) * ODD[8 + j]
        yield at, mix64(h)


class Matcher:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], percent: int) -> None:
        # long items first: short ones have no seeds, so only their numbers and lengths are looked at
        items = sorted(((i, w) for i, w in items if w), key=lambda x: len(x[1]) < LEAST_WORDS)
        self.percent, self.ids = percent, [i for i, _ in items]
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        for k, (_, w) in enumerate(items):
            if len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w), []).append(k)
        lengths = [len(w) for _, w in items]
        items = [(i, w) for i, w in items if len(w) >= LEAST_WORDS]
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.lengths = np.array(lengths, np.int64)
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        got = [(h, np.full(len(at), i, np.int32), at.astype(np.int32)) for i, c in enumerate(self.codes) for at, h in seeds(c, ITEM_MASKS)]
        hashes, item, place = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order].astype(np.uint64), item[order], place[order]
        self.shift = np.uint64(64 - min(FILTER_BITS, max(10, (8 * len(self.hashes)).bit_length())))
        self.bloom = np.zeros(1 << int(64 - self.shift), bool)
        self.bloom[(self.hashes >> self.shift).astype(np.int64)] = True

    def stretches(self, size: int) -> list[tuple[int, int]]:
        """(words in a row, errors allowed) of which any one is enough. Beyond nine stretches a whole item always holds a good one."""
        errors = lambda w: w * (100 - self.percent) // 100
        return [(w, errors(w)) for w in sorted({min(size, STRETCH), size if size < 9 * STRETCH else STRETCH})] + [(RUN, 0)] * (size > RUN)

    @staticmethod
    def aligned(codes: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, w: int, errors: int) -> np.ndarray:
        """Whether ``w`` words in a row of item ``c``, laid at ``first`` within lo to hi, agree but for ``errors``; a banded edit distance."""
        shift = np.arange(-errors, errors + 1)
        ok = np.zeros(len(first), bool)

        def same(at: np.ndarray, k: np.ndarray, want: np.ndarray) -> np.ndarray:
            inside = (at >= lo[k][:, None]) & (at < hi[k][:, None])
            return (codes[np.where(inside, at, 0)] == want) & inside

        step = 1 + 2_000_000 // len(c)
        for z in range(0, len(first), step):
            k = np.arange(z, min(z + step, len(first)))
            # no alignment has more words that agree than stand anywhere in reach
            can = np.zeros((len(k), len(c) + 1), np.int32)
            for s in shift:
                can[:, 1:] |= same(first[k][:, None] + np.arange(len(c)) + s, k, c)
            total = can.cumsum(1)
            row, start = np.nonzero(total[:, w:] - total[:, :-w] >= w - errors)
            part = 1 + 2_000_000 // len(shift)
            for y in range(0, len(row), part):
                r, a = k[row[y : y + part]], start[y : y + part]
                r, a = r[~ok[r]], a[~ok[r]]
                cost = np.zeros((len(r), len(shift)), np.int32)
                for j in range(w):
                    new = cost + ~same((first[r] + a + j)[:, None] + shift, r, c[a + j][:, None])
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(new - shift, 1) + shift
                ok[r[cost.min(1) <= errors]] = True
        return ok

    def lines(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """As :meth:`find`, short items: those that are a whole line of a text, or the whole text."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for d, t in enumerate(texts if self.short else []):
            at = 0
            parts = [words(line) for line in re.split(r"[\r\n]+", t or "")]
            for ws in [*parts, [w for p in parts for w in p] if sum(map(len, parts)) < LEAST_WORDS else []]:
                for i in self.short.get(tuple(ws), ()) if len(ws) < LEAST_WORDS else ():
                    out.setdefault((d, i), (d, i, min(at, sum(map(len, parts)) - len(ws)), len(ws)))
                at += len(ws)
        return list(out.values())

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(number of the text, number of the item, first word, words that agree), each item once a text, where it agrees best."""
        return sorted(self.lines(texts) + self.seeded(texts))

    def seeded(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        parts, starts, n = [], [], 0
        gap = np.full(max((m[-1] for m in MASKS)), -1, np.int64)
        for t in texts:
            ws = words(t)
            starts.append(n)
            parts += [np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws)), gap]
            n += len(ws) + len(gap)
        if not n or not len(self.hashes):
            return []
        codes, starts = np.concatenate(parts), np.array(starts)
        places, items = [], []
        for at, h in seeds(codes):
            ok = self.bloom[(h >> self.shift).astype(np.int64)]
            at, h = at[ok], h[ok]
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            k = hi - lo
            src = np.repeat(np.arange(len(h)), k)
            row = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]).astype(np.int64), k) + np.arange(k.sum()) if len(k) else np.zeros(0, np.int64)
            places.append(at[src] - self.place[row])
            items.append(self.item[row] + at[src] * 0)
            # the text that the hit lies in, so that an item laid over its edge stays in it
            places[-1] = np.stack([places[-1], np.searchsorted(starts, at[src], "right") - 1])
        place, item = np.concatenate(places, 1), np.concatenate(items)
        keys = np.unique(np.stack([place[1], item, place[0]]), axis=1)
        ends = np.append(starts[1:], n)
        out = []
        for i in np.unique(keys[1]):
            doc, _, first = keys[:, keys[1] == i]
            c, size = self.codes[i], len(self.codes[i])
            ok = np.zeros(len(doc), bool)
            for w, errors in self.stretches(size):
                left = np.flatnonzero(~ok)
                ok[left] = self.aligned(codes, c, starts[doc[left]], ends[doc[left]], first[left], w, errors)
            near = size * (100 - self.percent) // 100
            for d in np.unique(doc[ok]):
                def agree(f: np.ndarray) -> np.ndarray:
                    at = f[:, None] + np.arange(size)
                    inside = (at >= starts[d]) & (at < ends[d])
                    return (codes[np.where(inside, at, 0)] == c) & inside

                own = first[ok & (doc == d)]
                step = 1 + 2_000_000 // size
                best = own[np.concatenate([agree(own[k : k + step]).sum(1) for k in range(0, len(own), step)]).argmax()]
                # pieces that words left out or put in have shifted
                beside = first[(doc == d) & (np.abs(first - best) <= near)]
                out.append((int(d), int(i), int(best - starts[d]), int(agree(beside).any(0).sum())))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of about ``most`` words; the driver holds one block at a time."""
    block, n = [], 0
    for r in benchmark.selectExpr("cast(item_id as bigint) item_id", "text").filter("text is not null").toLocalIterator():
        ws = words(r["text"])
        if block and n + len(ws) > most:
            yield block
            block, n = [], 0
        block.append((r["item_id"], ws))
        n += len(ws)
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = 80, most: int = BLOCK_WORDS) -> DataFrame:
    """Items found in documents: (doc_id, item_id, first_word, n_same, n_words), each item once a row of ``docs``.

    Looks at doc_id and text, item_id and text alone. Null texts hold nothing, null items are not looked for; repeated items
    are found each. n_same counts the item's words that agree at first_word or, shifted, near it; it is small where only a part
    is quoted. A negative first_word means that the item's beginning lies before the text's.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word long, n_same long, n_words long"
    kinds = [pa.int64()] * 5
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    found = []
    for block in blocks(benchmark, most):
        kept = spark.sparkContext.broadcast(Matcher(block, percent))

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            m = kept.value
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    hits = m.find(part.column("text").to_pylist())
                    cols = zip(*((ids[d], m.ids[i], first, same, int(m.lengths[i])) for d, i, first, same in hits)) if hits else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "first_word", "n_same", "n_words"])

        if found:
            found[-1] = materialise(found[-1], "overlaps")
        found.append(rows.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold benchmark items, and no others: (doc_id, n_items, items, best), items as their ids, comma-joined.

    Null texts and null items hold nothing; rows of one doc_id are one document; rows with a null doc_id too, as their ids tell
    them apart no more; empty tables give none; other columns are not looked at.
    """
    g = overlaps(docs, benchmark, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("i"), F.max(F.col("n_same") / F.col("n_words")).alias("best"))
    return g.select("doc_id", F.size("i").cast("long").alias("n_items"), F.array_join(F.col("i").cast("array<string>"), ",").alias("items"), "best")


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, most: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; nothing is shuffled."""
    spark = docs.sparkSession
    for k, block in enumerate(blocks(benchmark, most)):
        kept = spark.sparkContext.broadcast(Matcher(block, percent))

        docs = (materialise(docs, "clean") if k else docs).filter(_clean(kept)("text"))
    return docs


def _clean(kept):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        at = size = 0
        for i, t in enumerate([*texts, None]):
            if i == len(texts) or size > 4_000_000:
                for d, *_ in kept.value.find(list(texts.iloc[at:i])):
                    out[at + d] = False
                at, size = i, 0
            size += len(t or "")
        return pd.Series(out)
    return clean
