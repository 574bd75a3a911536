"""Operator 3: toxicity, by a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word enters as a learned vector of its hashed form and the mean of learned vectors of its hashed character sequences,
beginnings and ends included; words beyond ``LONG`` characters enter as overlapping pieces. A forward and a backward gated
recurrent layer read a window of ``WINDOW`` words, attention pools their states, and a logistic unit scores the window. Windows
overlap by half and cover the whole text; a text's score is that of its highest window. Trained in numpy by back-propagation, on a bounded sample of labelled rows; windows are chosen
anew before each round (of a toxic text the highest, of others the highest and a random one), as labels mark texts, not windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN = 6, 8, 8
#: Labelled rows of either label that are learned from, at most, and how long their texts may be (documented bound of the sample).
TOXIC_ROWS, CLEAN_ROWS, LEARN_CHARS = 800, 1200, 8_000
ROUNDS = 5
THRESHOLD = 0.3
#: Windows run through the network at once.
BATCH = 4096
KEPT = 100_000
#: Words whose features are made at once, which bounds the memory that it takes.
STEP = 8192
#: Characters of a word input at most, and of the pieces that longer ones are cut into: short, as words in them are to tell.
LONG, PIECE = 40, 8
#: Where words beyond that are cut first.
SEPARATORS = re.compile(r"[/\\_,;:|.\-()\[\]{}<>\"=&?~‐-―…«»“”、。，；：？！・「」『』（）]+")
STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”‘’…–—"


def pieces(words: list[str]) -> list[str]:
    """The words, those beyond ``LONG`` characters cut at separators, and what is still longer into pieces of ``PIECE`` characters
    that overlap by half and cover it whole."""
    if max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for w in words:
        if len(w) > LONG:
            w = w.strip(STRIP) or w
        for x in [w] if len(w) <= LONG else [x for x in SEPARATORS.split(w) if x] or [w]:
            out += [x] if len(x) <= LONG else [x[min(i, len(x) - PIECE) :][:PIECE] for i in range(0, len(x) - PIECE // 2, PIECE // 2)]
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of at most ``LONG`` characters (without surrounding marks, which are left off; a word of marks alone keeps
    them) the row of its vector, and its character rows: flat, with their numbers."""
    cut = [f"<{w.strip(STRIP) or w}>" for w in words]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    codes = np.array(cut, dtype=f"U{LONG + 2}").view(np.uint32).reshape(len(cut), LONG + 2).astype(np.uint64)
    codes *= np.arange(LONG + 2) < n[:, None]
    width = int(n.max(initial=3))
    rows, owners = [], []
    for size in (3, 4):
        h = np.full((len(cut), width - size + 1), np.uint64(size))
        for j in range(size):
            h = (h ^ codes[:, j : j + h.shape[1]]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        own, at = np.nonzero(np.arange(h.shape[1]) + size <= n[:, None])
        rows.append(h[own, at]), owners.append(own)
    h = np.full(len(cut), np.uint64(7))
    for j in range(width):
        h = np.where(j < n, (h ^ codes[:, j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), h)
        if j + 1 in (5, 6, 7):
            own = np.flatnonzero(n > j)
            rows.append(h[own]), owners.append(own)
    fold = lambda x, m: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % m
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return fold(h, WORD_ROWS), fold(np.concatenate(rows), CHAR_ROWS)[order], np.bincount(own, minlength=len(cut))


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words, one at least."""
    return [(0, n)] if n <= WINDOW else [(min(i, n - WINDOW), min(i, n - WINDOW) + WINDOW) for i in range(0, n - WINDOW + STRIDE, STRIDE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of rows by number."""
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)


class Words:
    """Words met, numbered from 1 (0 is padding)."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = []

    def of(self, text: str | None) -> np.ndarray:
        ws = pieces((text or "").lower().split())
        for w in {w for w in ws if w not in self.ids}:
            self.names.append(w)
            self.ids[w] = len(self.names)
        return np.fromiter(map(self.ids.__getitem__, ws), np.int32, len(ws))

    def arrays(self, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, character rows, and the word that each character row belongs to, for words numbered from ``since``."""
        names = self.names[max(0, since - 1) :]
        parts = [features(names[k : k + STEP]) for k in range(0, len(names), STEP)] or [features([])]
        word, chars, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if since == 0:
            word, n = np.append([0], word), np.append([0], n)
        return word, chars, np.repeat(np.arange(len(n)), n)


class Network:
    """Parameters ``p``, forward and backward passes."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": g(WORD_ROWS, WORD_DIM), "char": g(CHAR_ROWS, CHAR_DIM), "v": g(2 * h), "o": g(2 * h), "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": g(d, 3 * h, k=0.3), f"c{k}": np.zeros(3 * h, np.float32), f"U{k}": g(h, 3 * h, k=0.25)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Vectors of words."""
        row, chars, owner = words
        n = np.maximum(np.bincount(owner, minlength=len(row)), 1).astype(np.float32)
        c = sums(owner, self.p["char"][chars], len(row))
        return np.concatenate([self.p["word"][row], c / n[:, None] * 3], 1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What words add to the gates of either direction; does not depend on their place, so each word is projected once."""
        return {k: x @ self.p[f"W{k}"] + self.p[f"c{k}"] for k in "fb"}

    def forward(self, ids: np.ndarray, proj: dict[str, np.ndarray], keep: bool = False):
        """Logits of windows [n, T] of word numbers, 0 as padding at the end."""
        p, h, (n, T) = self.p, HIDDEN, ids.shape
        mask = (ids > 0).astype(np.float32)
        states = np.zeros((T, n, 2 * h), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for k, order in (("f", range(T)), ("b", range(T - 1, -1, -1))):
            s, U, at = np.zeros((n, h), np.float32), p[f"U{k}"], 0 if k == "f" else h
            for t in order:
                x = proj[k][ids[:, t]]
                g = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + s @ U[:, : 2 * h]))  # sigmoid
                z, r = g[:, :h], g[:, h:]
                rs = r * s
                c = np.tanh(x[:, 2 * h :] + rs @ U[:, 2 * h :])
                m = mask[:, t : t + 1] * z
                new = s + m * (c - s)
                if keep:
                    saved[k].append((t, s, z, r, rs, c))
                states[t, :, at : at + h] = s = new
        e = states @ p["v"] + (mask.T - 1) * 1e4
        a = np.exp(e - e.max(0)) * mask.T
        a /= np.maximum(a.sum(0), 1e-9)
        pool = (states * a[:, :, None]).sum(0)
        logit = pool @ p["o"] + p["b"][0]
        return (logit, (states, a, pool, mask, saved)) if keep else logit

    def backward(self, ids: np.ndarray, d: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the parameters above the projection, and of the projected words at each place, for dL/dlogit ``d``."""
        p, h, (n, T) = self.p, HIDDEN, ids.shape
        states, a, pool, mask, saved = kept
        g = {"o": pool.T @ d, "b": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        da = (states * dpool).sum(2)
        de = a * (da - (a * da).sum(0))
        g["v"] = (states * de[:, :, None]).sum((0, 1))
        dstates = a[:, :, None] * dpool + de[:, :, None] * p["v"]
        dx = {}
        for k in "fb":
            U, at = p[f"U{k}"], 0 if k == "f" else h
            gU, out, ds = np.zeros_like(U), np.zeros((T, n, 3 * h), np.float32), np.zeros((n, h), np.float32)
            for t, s, z, r, rs, c in reversed(saved[k]):
                ds = ds + dstates[t, :, at : at + h]
                m = mask[:, t : t + 1]
                dz, dc = ds * m * (c - s) * z * (1 - z), ds * m * z * (1 - c * c)
                drs = dc @ U[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                out[t] = dg
                gU[:, : 2 * h] += s.T @ dg[:, : 2 * h]
                gU[:, 2 * h :] += rs.T @ dc
                ds = ds * (1 - m * z) + drs * r + dg[:, : 2 * h] @ U[:, : 2 * h].T
            g[f"U{k}"], dx[k] = gU, out
        return g, dx

    def step(self, ids: np.ndarray, y: np.ndarray, words: tuple, starts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of all parameters on windows labelled ``y``; word ``w`` has the character rows from ``starts[w]`` to the next."""
        row, chars, _ = words
        used, small = np.unique(np.append(ids.ravel(), 0), return_inverse=True)
        small = small[:-1].reshape(ids.shape)
        n = starts[used + 1] - starts[used]
        own = np.repeat(np.arange(len(used)), n)
        which = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        part = self.inputs((row[used], chars[which], own))
        logit, kept = self.forward(small, self.projected(part), keep=True)
        prob = sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        g, dx = self.backward(small, ((prob - y) / len(y)).astype(np.float32), kept)
        dpart, at = np.zeros_like(part), small.T.ravel()
        for k in "fb":
            per = sums(at, dx[k].reshape(-1, 3 * HIDDEN), len(part))
            g[f"W{k}"], g[f"c{k}"] = part.T @ per, per.sum(0)
            dpart += per @ self.p[f"W{k}"].T
        g["word"] = sums(row[used], dpart[:, :WORD_DIM], WORD_ROWS)
        g["char"] = sums(chars[which], (dpart[:, WORD_DIM:] * 3 / np.maximum(n, 1)[:, None])[own], CHAR_ROWS)
        return loss, g

    def score(self, texts: list[str | None], words: Words | None = None) -> np.ndarray:
        """Logit of each text, over all its windows."""
        words = words or Words()
        ids = [words.of(t) for t in texts]
        return self.highest(ids, self.projected(self.inputs(words.arrays())))[0]

    def highest(self, ids: list[np.ndarray], proj: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest logit and the window that has it."""
        spans = [(i, a, b) for i, x in enumerate(ids) for a, b in windows(len(x))]
        spans.sort(key=lambda s: s[2] - s[1])
        best, where = np.full(len(ids), -np.inf, np.float32), np.zeros((len(ids), 2), np.int64)
        for k in range(0, len(spans), BATCH):
            part = spans[k : k + BATCH]
            block = np.zeros((len(part), max(1, part[-1][2] - part[-1][1])), np.int32)
            for j, (i, a, b) in enumerate(part):
                block[j, : b - a] = ids[i][a:b]
            logit = self.forward(block, proj)
            for (i, a, b), v in zip(part, logit.tolist()):
                if v > best[i]:
                    best[i], where[i] = v, (a, b)
        return best, where

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(logits.astype(np.float64) * self.scale + self.shift)


def fit(texts: list[str | None], labels: list[int], seed: int = 3, rounds: int = ROUNDS) -> Network:
    """Learn from labelled texts. Without both labels, the network scores everything by the share of label 1."""
    net, y = Network(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.scale, net.shift = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -5.0)
        return net
    r = np.random.default_rng(seed)
    words = Words()
    ids = [words.of(t) for t in texts]
    arrays = words.arrays()
    row, chars, owner = arrays
    # the first windows of toxic texts: round the word whose character sequences tell the labels apart best
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(row)))])
    tally = np.zeros((2, CHAR_ROWS))
    for x, label in zip(ids, labels):
        u = np.unique(x)
        tally[label][np.unique(np.concatenate([chars[starts[w] : starts[w + 1]] for w in u]) if len(u) else [])[:].astype(int)] += 1
    odds = np.log((tally[1] + 0.5) / (y.sum() + 1)) - np.log((tally[0] + 0.5) / (len(y) - y.sum() + 1))
    odds *= tally[1] >= 3
    value = np.zeros(len(row))
    np.maximum.at(value, owner, odds[chars])
    first = np.array([max(windows(len(x)), key=lambda s: np.sort(value[x[s[0] : s[1]]])[-3:].sum()) if len(x) else (0, 0) for x in ids])
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    n = 0
    for k in range(rounds):
        where = first if k == 0 else net.highest(ids, net.projected(net.inputs(arrays)))[1]
        jobs = [(i, *w) for i, w in enumerate(where)]
        jobs += [(i, *windows(len(ids[i]))[r.integers(len(windows(len(ids[i]))))]) for i in np.flatnonzero(y == 0)]
        for _ in range(2):
            order = r.permutation(len(jobs))
            for at in range(0, len(order), 64):
                part = [jobs[j] for j in order[at : at + 64]]
                block = np.zeros((len(part), max(1, max(b - a for _, a, b in part))), np.int32)
                for j, (i, a, b) in enumerate(part):
                    block[j, : b - a] = ids[i][a:b]
                _, g = net.step(block, y[[i for i, *_ in part]], arrays, starts)
                n += 1
                rate = 0.01 * (0.3 if k >= rounds - 2 else 1)
                for name, v in g.items():
                    m1[name] += 0.1 * (v - m1[name])
                    m2[name] += 0.01 * (v * v - m2[name])
                    net.p[name] -= rate * (m1[name] / (1 - 0.9**n)) / (np.sqrt(m2[name] / (1 - 0.99**n)) + 1e-7)
    # a logistic fit of the label on the texts' highest logits
    z = net.highest(ids, net.projected(net.inputs(arrays)))[0].astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    a, b = 1.0, 0.0
    for _ in range(200):
        d = (sigmoid(a * z + b) - np.where(y == 1, 0.98, 0.02)) * weight / len(y)
        a, b = a - 0.1 * (d * z).sum() / 4, b - 0.1 * d.sum()
    net.scale, net.shift = max(a, 0.05), b
    return net


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Network:
    """Fit on labelled rows that are not held out: of either label at most ``TOXIC_ROWS`` and ``CLEAN_ROWS``, those with the
    smallest hashes of their ids among texts of at most ``LEARN_CHARS`` characters. That bounds what the driver gathers."""
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = None
    for label, n in ((1, 3 * TOXIC_ROWS), (0, 3 * CLEAN_ROWS)):
        part = marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        few = part if few is None else few.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= LEARN_CHARS).join(F.broadcast(few), "doc_id")
    rank = F.xxhash64("doc_id")
    got = [rows.filter(F.col("toxic") == label).orderBy(rank, "doc_id", "text").limit(n) for label, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    sample = got[0].unionByName(got[1]).select("text", "toxic").collect()
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample], seed)


class Scorer:
    """A network in a task, with the projections of words kept between batches."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.proj = {k: v[:0] for k, v in self.net.projected(np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)).items()}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words.names) > KEPT:
            self.clear()
        ids = [self.words.of(t) for t in texts]
        since = len(self.proj["f"])
        if since <= len(self.words.names):
            new = self.net.projected(self.net.inputs(self.words.arrays(since)))
            self.proj = {k: np.concatenate([self.proj[k], new[k]]) for k in new}
        return self.net.probability(self.net.highest(ids, self.proj)[0])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity of every whole text: (doc_id, held_out, score, predicted).

    A null text is scored as an empty one; a null doc_id is not held out and stays null; repeated rows are scored each. With no
    usable labels the score is the same for all. Other columns are not looked at. Documents are not shuffled.
    """
    kept = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(kept.value)  # goes with the task: the worker may serve other operators next
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                s = of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the network marks as toxic; nothing is shuffled."""
    return docs.filter(_passes(docs.sparkSession.sparkContext.broadcast(train(docs, labels)), threshold)("text"))


def _passes(kept, threshold: float):
    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Scorer(kept.value)
        for texts in batches:
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > 1_000_000:
                    out.append(of(part) < threshold)
                    part, size = [], 0
            yield pd.Series(np.concatenate([*out, of(part) < threshold]) if part or out else np.zeros(0, bool))

    return passes
