"""Training-data operators against brute force, the library they must agree with, and edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parflow.llm import chat, decontaminate, html_text, license_scan, media, mixing, near_dedup, queries, shingles, token_counts, token_files, toxicity
from parflow.llm.license_rules import BASE, RULES

P = pytest.importorskip("public_tokenizers")
WORD = r"[^\x20\x09-\x0D]+"
#: Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use inside.
TEXTS = [None, "", " \t\n", "one", "The same words stand here twice and again", "The same words stand here twice and again", "Don't  stop,\n\nit's 42 €5 … naïve ﬁ x²", "a <|endoftext|> b", "日本語 テキスト x\x1cy", "lorem ipsum dolor " * 9000]
SCHEMA = "doc_id long, text string, source string, n_tokens string, score string, labels string, s string, k int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["b", "a", None][i % 3], "x", "y", "z", "s", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", "a", None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


# -- 1
def test_mixing(spark, odd, empty):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 40), r.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, target, left = set(order), {}, sum(size.values())
    while True:  # as the contract words it
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    assert len(got) == 3000 and (got.taken <= 3 * got["size"]).all()
    for s in order:
        own = got[got.source.isna() if s is None else got.source == s]
        assert (own.source_size == size[s]).all() and own.target.iloc[0] == pytest.approx(target[s])
        assert abs(own.taken.sum() - target[s]) <= 150
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    copies = mixing.mixed_documents(docs).groupBy("doc_id").count().toPandas()
    want = got[got.copies > 0]
    assert dict(zip(copies.doc_id, copies["count"])) == dict(zip(want.doc_id, want.copies))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixing_of_sparse_ids_and_clashing_names(spark):
    r = random.Random(3)
    ids = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + list(range(5)) + [(1 << 63) - 1, -(1 << 63)]
    rows = [(i, "w " * r.choice([0, 1, 3, 3, 3]), r.choice("ab"), 1) for i in ids] + [(None, None, "a", 1)] * 3 + [(None, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_id int").selectExpr("*", "1 as mix_s", "2 as copies", "3 as block", "4 as b1", "5 as taken")
    got = mixing.mix(docs.repartition(3)).collect()
    for s in "ab":
        own = sorted((x for x in got if x["source"] == s), key=lambda x: (x["size"], x["doc_id"] is not None, x["doc_id"] or 0))
        rate = min(3, own[0]["target"] / own[0]["source_size"])
        u = int(hashlib.md5(f"17:={s}".encode()).hexdigest()[:5], 16) / 2**20
        named = [(k, x) for k, x in enumerate(own) if x["doc_id"] is not None]
        assert [x["copies"] for _, x in named] == [int((k + 1) * rate + u) - int(k * rate + u) for k, _ in named]
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).filter("doc_id is not null").count() == sum(x["copies"] for x in got if x["doc_id"] is not None)


# -- 2
def test_long_units_are_not_kept():
    c = token_counts.Counts(P.path("byte_bpe_50k.json"))
    text = " ".join("ab" * 100 + str(i) for i in range(50)) + " " + "z" * 5000
    assert c.count(text) == len(c.library.encode(text, add_special_tokens=False).ids) == c.count(text)
    assert not c.units and max(map(len, c.pieces), default=0) <= token_counts.KEPT_CHARS
    assert c.plain and not token_counts.cuts_as_known({"model": {}, "normalizer": {"type": "NFC"}})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé'st .,\n\t0 9²…— <|>日 \x1c")), max_size=40))
def test_units_count_as_whole_texts(text):
    c = token_counts.Counts.of(P.path("byte_bpe_50k.json"))
    assert c.count(text) == len(c.library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZéÉ'st .,\n\t0 9²…— <|>日 \x1c")), max_size=40))
def test_units_encode_as_whole_texts(text):
    c = token_files.Ids.of(P.path("word_bpe_49k.json"))
    assert c.encode(text).tolist() == c.library.encode(text, add_special_tokens=False).ids


def test_plain_characters_are_cut_alike():
    for name, cls in (("byte_bpe_50k.json", token_counts.Counts), ("word_bpe_49k.json", token_files.Ids)):
        c = cls.of(P.path(name))
        for ch in map(chr, range(0x250)):
            for text in (f"a{ch}b", f"1{ch} .{ch}!", f" {ch}  {ch}A"):
                ids = c.library.encode(text, add_special_tokens=False).ids
                assert (c.count(text) == len(ids)) if cls is token_counts.Counts else (c.encode(text).tolist() == ids), (name, text)


def test_token_counts(odd, empty):
    path = P.path("byte_bpe_50k.json")
    t = token_counts.load(path)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(odd, path).collect()}
    for i, text in enumerate(TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((text or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(odd, path).count() == odd.count() and token_counts.count_tokens(empty, path).count() == 0


# -- 3
def test_gradients():
    net = toxicity.Network(0)
    w = toxicity.Words()
    a, b = w.of("you are a bad bad word"), w.of("good day to all")
    block = np.zeros((2, 6), np.int32)
    block[0], block[1, :4] = a, b
    arrays = w.arrays()
    starts = np.concatenate([[0], np.cumsum(np.bincount(arrays[2], minlength=len(arrays[0])))])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) * (3 if k not in "b" else 1)
    y = np.array([1.0, 0.0])
    _, g = net.step(block, y, arrays, starts)
    r = np.random.default_rng(0)
    for name in net.p:
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in r.choice(np.flatnonzero(np.abs(grad) > 1e-6), 3) if (np.abs(grad) > 1e-6).any() else []:
            old = flat[i]
            loss = []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                loss.append(net.step(block, y, arrays, starts)[0])
            flat[i] = old
            assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(grad[i], rel=0.05, abs=2e-4), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 32, 33, 48, 49, 500):
        ws = toxicity.windows(n)
        assert ws[0][0] == 0 and ws[-1][1] == n
        assert all(b[0] < a[1] for a, b in zip(ws, ws[1:])) and all(b - a <= toxicity.WINDOW for a, b in ws)


def test_long_words_enter_whole():
    for n in (1, 39, 40, 41, 45, 100, 1001):
        w = "".join(chr(0x4E00 + k) for k in range(n))
        got = toxicity.pieces(["a", w, "b"])
        assert got[0] == "a" and got[-1] == "b" and all(len(x) <= toxicity.LONG for x in got)
        assert all(any(w[k : k + 4] in x for x in got) for k in range(n))
    assert toxicity.pieces(["x" * 40 + "/" + "y" * 20 + "_z"]) == ["x" * 40, "y" * 20, "z"]
    assert "".join(toxicity.pieces(["-" * 50])) and toxicity.pieces([]) == []


def test_toxic_wording_inside_long_words():
    r = random.Random(3)
    fine = ["".join(r.choice(["the", "an", "er", "on", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    text = lambda y: [r.choice(fine) for _ in range(30)] + ["idiot", "scum", "idiot"] * y + [r.choice(fine) for _ in range(30)]
    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    net = toxicity.fit([" ".join(ws) for ws, _ in rows], [y for _, y in rows])
    new = [(text(i % 2), i % 2) for i in range(40)]
    y = np.array([y for _, y in new])
    for mark in (" ", "/", "_", ",", "—"):
        assert ((net.probability(net.score([mark.join(ws) for ws, _ in new])) >= toxicity.THRESHOLD) == y).sum() >= 39, mark
    a, b = net.score(["的" * 500 + "idiotscum" + "的" * 500, "的" * 1009])
    assert a > b


def test_scores_are_those_of_plain_windows(monkeypatch):
    r = random.Random(4)
    net = toxicity.Network(5)
    for k, v in net.p.items():
        net.p[k] = (v * 3).astype(np.float32)
    texts = [None, "", "one", " ".join(f"w{r.randrange(60)}" for _ in range(31)), " ".join(f"w{r.randrange(60)}" for _ in range(200)), "x" * 90 + " y"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def plain(ws):
        """One window, word by word."""
        x = []
        for w in ws:
            row, chars, _ = toxicity.features([w])
            x.append(np.concatenate([net.p["word"][row[0]], net.p["char"][chars].mean(0) * 3]).astype(float))
        states, h = np.zeros((len(ws), 2 * toxicity.HIDDEN)), toxicity.HIDDEN
        for k, order, at in (("f", range(len(ws)), 0), ("b", reversed(range(len(ws))), h)):
            s, W, U, c = np.zeros(h), net.p[f"W{k}"], net.p[f"U{k}"], net.p[f"c{k}"]
            for t in order:
                g = x[t] @ W + c
                z, reset = sig(g[:h] + s @ U[:, :h]), sig(g[h : 2 * h] + s @ U[:, h : 2 * h])
                s = (1 - z) * s + z * np.tanh(g[2 * h :] + (reset * s) @ U[:, 2 * h :])
                states[t, at : at + h] = s
        a = np.exp(states @ net.p["v"])
        return float((a / a.sum()) @ states @ net.p["o"] + net.p["b"][0]) if len(ws) else float(net.p["b"][0])

    want = []
    for t in texts:
        ws = toxicity.pieces((t or "").lower().split())
        want.append(max(plain(ws[a:b]) for a, b in toxicity.windows(len(ws))))
    assert net.score(texts) == pytest.approx(want, abs=2e-3)
    monkeypatch.setattr(toxicity, "STEP", 7)
    assert net.score(texts) == pytest.approx(want, abs=2e-3)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    if not os.path.isdir(at):
        pytest.skip("no test data")
    got = toxicity.score(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).filter("held_out")
    got = got.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("toxic is not null").toPandas()
    bad, fine = got[got.toxic == 1], got[got.toxic == 0]
    assert bad.predicted.mean() >= 0.7 and fine.predicted.mean() <= 0.1, (len(bad), bad.predicted.mean(), len(fine), fine.predicted.mean())


def test_toxicity(spark, odd, empty):
    r = random.Random(2)
    fine = ["".join(r.choice(["the", "an", "er", "on", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    rows, marks = [], []
    for i in range(700):
        ws, y = [r.choice(fine) for _ in range(r.randint(5, 120))], int(i % 4 == 0)
        for _ in range(3 if y else 0):
            ws.insert(r.randrange(len(ws)), r.choice(["idiot", "scum", "zorg" + r.choice(fine)]))
        rows.append((i, " ".join(ws)))
        marks.append((i, y))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in range(700)])
    assert (got.held_out.values == held).all()
    y = np.array([m for _, m in marks])
    assert ((got.predicted.values == y) | ~held).sum() >= 700 - 5
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    none = labels.limit(0)
    out = toxicity.score(odd, none).collect()
    assert len(out) == odd.count() and len({x["score"] for x in out}) == 1
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.accepted(odd, none).columns == odd.columns


# -- 4
def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> The big site</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies to improve your visit, as our policy says at length in many words.</div><script>var t="</p>";</script>
<article><h1>Head &amp; tail</h1><p>First   para <a href=x>link</a> &eacute;.<br>next<p>Two.<ul><li>item one</ul><table><tr><td>cell</td></tr></table></article>
<aside><p>Another story that is long enough to be a paragraph in its own right, is it not?</p></aside><div id="comments"><p>I think this is a good article and I will read it again soon.</p></div><form>Name <input></form><footer>&copy; 2020</footer>"""
    assert html_text.main_text(page) == "Head & tail\nFirst para link é. next\nTwo.\nitem one\ncell"
    for p in (None, "", "<", "<p", "<!-- x", "<script>", "</p></div>", "<a><b></a></b>"):
        html_text.main_text(p)
    assert html_text.main_text(None) == ""


def test_main_text_of_other_layouts():
    t = html_text.main_text
    long = "words of a text that goes on " * 12
    assert t("<article><p>First one.</p><svg/><p>Second.</p></article>") == "First one.\nSecond."
    assert t("<article><p>First one.</p><select><p>Second.</p></article>") == "First one.\nSecond."
    assert t("<article><p>a<math>x</math> b</p><noscript><p>no</p></noscript><object>obj</object></article>") == "ax b\nno\nobj"
    assert t("<article><header><h1>Title</h1></header><p>Text of it.</p></article>") == "Title\nText of it."
    # no article element; names that mislead; a form round everything
    for div in ('<div class="post tag-news">', '<div class="content promo-2020">', "<div>", '<div class="has-sidebar layout">'):
        page = f"<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>{div}<p>{long}</p><p>Short one.</p><p>{long}</p></div><footer>c 2020 by <a href=/i>us</a></footer>"
        assert t(page) == f"{long.strip()}\nShort one.\n{long.strip()}", div
    assert t(f"<form><nav><a href=/>Home</a> <a href=/n>News</a></nav><div><p>{long}</p><p>{long}</p></div></form>") == f"{long.strip()}\n{long.strip()}"
    assert t(f"<article><p>{long}</p><div class=comments><p>I like it.</p></div></article><aside><p>{long}</p></aside>") == long.strip()
    assert t("<article><p title=it's>one</p><p title='a>b'>two</p></article>") == "one\ntwo"


def test_labelled_blocks_and_the_tree():
    rows = html_text.labelled_table()
    assert sum(html_text.is_article(x[:-1]) == x[-1] for x in rows) > 0.99 * len(rows)
    node, used = [html_text.tree()], set()
    while node:
        x = node.pop()
        if isinstance(x, tuple):
            used.add(html_text.FIELDS[x[0]])
            node += x[2:]
    assert {"words", "links", "after_words", "place"} <= used


def test_hostile_pages_take_time_in_proportion():
    import time

    for x in ("<a ", "<i></u>", "<div>", "<select>", "<p a='", "<b><div></b>", "<script", "<!--", "</p", "<div class=ad>x", "<a href=x>y<p>"):
        began = time.process_time()
        html_text.main_text(x * (1_000_000 // len(x)))
        assert time.process_time() - began < 30, x


def test_main_text_of_all_pages():
    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.isfile(at):
        pytest.skip("no test data")
    import html

    for page in pq.read_table(at).column("html").to_pylist():
        article = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article))
        assert html_text.main_text(page) == "\n".join(p for p in parts if p)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hi &lt;you&gt;</p></article>", "t"), (1, "u", "<article><p>Hi &lt;you&gt;</p></article>", "t"), (None, None, None, None), (3, "v", "", "")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()) == [("", 0), ("", 0), ("Hi <you>", 8), ("Hi <you>", 8)]
    assert html_text.extract(pages.limit(0)).count() == 0


# -- 5
def test_token_files(spark, odd, empty, tmp_path):
    path = P.path("word_bpe_49k.json")
    t = token_counts.load(path)
    manifest = token_files.write(odd, path, f"file://{tmp_path}/tokens", 3)
    got = token_files.read(manifest).toPandas()
    text = dict(enumerate(TEXTS)) | {None: "null id"}
    order = [None, *range(5), 4, *range(5, len(TEXTS))]
    at, want = 0, []
    for i in order:
        ids = np.array([*t.encode(text[i] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got.itertuples(index=False) if r[0] == r[0]) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(want)
    shard = manifest.filter("n_docs > 1").first()
    where = token_files.offsets(shard["path"])
    reader = token_files.Reader(shard["path"])
    shuffled = [reader.at(int(where[j])) for j in reversed(range(len(where)))]
    again = token_files.Reader(shard["path"])
    assert [s[0] for s in shuffled][::-1] == [again.next()[0] for _ in where] and again.next() is None
    file = shard["path"].removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    data[20] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(ValueError):
        token_files.Reader(shard["path"]).next()
    assert token_files.token_files(empty, path).count() == 0


def invented(seed, n, texts):
    """Texts of ASCII and accented words, most of them met often and some once, with digits and marks."""
    r = random.Random(seed)
    parts = ["an", "ber", "ción", "der", "éa", "ing", "lo", "on", "ste", "the", "wh", "ße", "x"]
    return [" ".join("".join(r.choices(parts, k=r.choice([1, 1, 2, 2, 2, 3, 3, 4]))) + r.choice(["", "", "", ",", ".", "'s", "42"]) for _ in range(n)) for _ in range(texts)]


def test_ids_of_batches(monkeypatch):
    path = P.path("word_bpe_49k.json")
    c = token_files.Ids(path)
    batch = [None, "", "  \n", *TEXTS, *invented(1, 200, 20), " a\tB  c ", "x" * 5000 + " don't 1234 —…"]
    want = [c.library.encode(t or "", add_special_tokens=False).ids for t in batch]
    array = pa.array([*batch, "cut off"], pa.string())
    for units, chars in ((token_files.UNITS, token_files.CHARS), (50, token_files.CHARS), (token_files.UNITS, 50)):
        monkeypatch.setattr(token_files, "UNITS", units)
        monkeypatch.setattr(token_files, "CHARS", chars)
        for step in (len(batch), 7, 1):
            assert [x.tolist() for i in range(0, len(batch), step) for x in c.encode_all(array.slice(i, min(step, len(batch) - i)))] == want
            assert max(len(c.units), len(c.pieces)) <= units + 4000
    assert list(c.encode_all(array.slice(0, 0))) == []
    assert [x.tolist() for x in c.encode_all(pa.array(batch, pa.large_string()))] == want


def test_ids_of_another_tokenizer_file():
    c = token_files.Ids(P.path("byte_bpe_50k.json"))
    for text in ["Don't  stop, it's 42", "naïve a b", "", None]:
        assert c.encode(text).tolist() == c.library.encode(text or "", add_special_tokens=False).ids


def test_ids_cost_a_fifth_of_the_library():
    import time

    path, texts = P.path("word_bpe_49k.json"), invented(2, 300, 2000)
    array = pa.array(texts)

    def cpu(f):
        took = []
        for _ in range(3):
            c = token_files.Ids(path)
            began = time.process_time()
            f(c)
            took.append(time.process_time() - began)
        return min(took)

    assert cpu(lambda c: list(c.encode_all(array))) < cpu(lambda c: c.library.encode_batch_fast(texts, add_special_tokens=False)) / 5


def test_ids_of_a_large_batch_take_little_memory():
    import tracemalloc

    c, array = token_files.Ids(P.path("word_bpe_49k.json")), pa.array(invented(3, 300, 2000))
    tracemalloc.start()
    for _ in c.encode_all(array):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def test_wide_ids_survive():
    ids = np.array([1, 70_000], np.uint32)
    assert token_files.record(5, ids)[12 + 9] == 4


# -- 6
def brute(rows, percent):
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").encode().lower().split() for _, t in rows)]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                lo, hi = sorted((root(ids[x]), root(ids[y])))
                parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def test_near_duplicates(spark, odd, empty):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 40, 120, 300]))]
        for _ in range(r.choice([1, 2, 4, 15])):
            ws = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(ws)))
    rows += [(5, None), (6, ""), (7, "tiny"), (8, "TINY"), (9, "a b c d"), (10, "a b c e")]
    for percent in (85, 80):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute(rows, percent)
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {x["component_id"] for x in out if x["doc_id"] is None} == {None}
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_screen(spark):
    from parflow.llm.common import screen

    rows = spark.range(3000).selectExpr("id", "id as bits", "1 as bucket").unionByName(spark.sql("select cast(null as bigint) id, cast(1 as bigint) bits, 1 bucket"))
    keys = spark.range(0, 3000, 7).selectExpr("id as k")
    into, out = screen(rows, "id", keys), screen(rows, "id", keys, inside=False)
    assert into.columns == rows.columns == out.columns
    assert into.filter("id % 7 = 0").count() == 429 and out.filter("id % 7 = 0").count() == 0
    assert into.count() + out.count() == 3001 and into.filter("id is null").count() == 0 and into.count() < 800
    assert screen(rows, "id", keys.limit(0)).count() == 0 and screen(rows, "id", keys.limit(0), inside=False).count() == 3001


def test_hot_bucket(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):  # a hot group: most texts have neighbours at the threshold, none is a copy
        ws = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            ws[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i + 1, " ".join(ws)))
    rows += [(200 + i, " ".join(f"{i} {j}" for j in range(30))) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute(rows, 85)


def test_repeated_ids_stay_once(spark):
    rows = [(1, "a text of words that is long enough", "x"), (1, "another text that has some other words", "y"), (1, "another text that has some other words", "z"), (2, "A text of words that is long enough", "v"), (None, "null", "n"), (3, "", "e"), (3, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for _ in range(2):
        got = near_dedup.deduplicated(docs.repartition(3))
        assert got.columns == docs.columns
        assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted([rows[0], rows[4], rows[6]], key=repr)


def test_odd_sketch_estimates_high_similarities():
    r = np.random.default_rng(0)
    for j in (0.8, 0.85, 0.95):
        n = 1000
        both = round(2 * n * j / (1 + j))
        pool = r.integers(0, 1 << 63, 2 * n - both, np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
        x = near_dedup.odd_sketch(near_dedup.signature(a)).view(np.uint64) ^ near_dedup.odd_sketch(near_dedup.signature(b)).view(np.uint64)
        assert int(np.unpackbits(x.view(np.uint8)).sum()) <= near_dedup.most_bits(j - near_dedup.MARGIN)


def test_sketch_filter_loses_next_to_no_pair():
    from math import comb

    n, k = 64 * near_dedup.SKETCH, near_dedup.BANDS * near_dedup.ROWS
    odd = np.zeros((k + 1, n + 1))  # chances of each number of odd bits, after two flips for each sample that differs
    row = np.zeros(n + 1)
    row[0] = 1
    at = np.arange(n + 1)
    for d in range(k + 1):
        odd[d] = row
        for _ in range(2):
            row = np.append(0, (row * (n - at) / n)[:-1]) + np.append((row * at / n)[1:], 0)
    for j, most in ((0.85, 1e-11), (0.8, 1e-9)):
        differ = np.array([comb(k, d) * (1 - j) ** d * j ** (k - d) for d in range(k + 1)])
        assert (differ @ odd)[near_dedup.most_bits(j - near_dedup.MARGIN) + 1 :].sum() < most


# -- 7
def test_chat(spark):
    for marks in (("User: ", "Assistant: "), ("### Human\n", "### Assistant\n"), ("<|user|>\n", "<|assistant|>\n"), ("**User:** ", "**AI:** ")):
        text = f"{marks[0]}What is it?\n{marks[1]}It is so.\nNote: a line with a colon.\n{marks[0]}Thanks"
        assert chat.parse(text) == [("user", "What is it?"), ("assistant", "It is so.\nNote: a line with a colon."), ("user", "Thanks")]
    assert chat.parse(None) == [] == chat.parse(" \n") and chat.render([]) == ""
    assert chat.parse("no marker at all") == [("user", "no marker at all")]
    e = chat.emissions(["User: hi", "text", "A: yes"])[:, :]
    import itertools

    best = max(itertools.product(range(chat.S), repeat=3), key=lambda s: chat.FIRST[s[0]] + e[0, s[0]] + sum(chat.NEXT[s[k - 1], s[k]] + e[k, s[k]] for k in (1, 2)))
    assert chat.viterbi(e) == list(best)
    rows = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", "there", 2), (1, 300, "user", "late", 3), (None, None, None, None, None), (None, 4, "assistant", "x", None), (2, 0, "user", "", 0), (2, 0, "user", "", 0)], "conv_id long, turn long, role string, text string, n_rows int")
    got = sorted(((r["conv_id"], r["n_rows"], r["roles"]) for r in chat.chats(rows).collect()), key=repr)
    assert got == [(1, 3, "user,assistant,user"), (2, 2, "user,user"), (None, 1, "assistant"), (None, 1, "user")]
    assert chat.chats(rows.limit(0)).count() == 0


def test_long_conversations_stay_whole(spark):
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" + "\nand more" * (k % 3)) for k in range(1000)]
    (got,) = chat.chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert got["n_turns"] == 1000 and got["chat"] == chat.render([(r, t) for _, _, r, t in rows])


# -- 8
def test_media_round_trips():
    r = np.random.default_rng(1)
    g, c = r.integers(0, 256, (5, 7), np.uint8), r.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_ppm(c)) == c).all()
    assert (media.decode(media.encode_bmp(c)) == c).all() and (media.decode(media.encode_bmp(g))[:, :, 1] == g).all()
    assert media.decode(b"P2\n# c\n2 2\n300\n1 2 3 300").tolist() == [[1, 2], [3, 300]]
    assert media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    for bad in (None, b"", b"P5", b"BM", b"P5\n9 9\n255\n1", b"GIF89a"):
        assert media.decode(bad) is None
    a = r.random((13, 9))
    want = np.zeros((4, 5))
    for i in range(4):
        for j in range(5):
            t = b = 0.0
            for y in range(13):
                for x in range(9):
                    k = max(0, min(y + 1, (i + 1) * 13 / 4) - max(y, i * 13 / 4)) * max(0, min(x + 1, (j + 1) * 9 / 5) - max(x, j * 9 / 5))
                    t, b = t + k * a[y, x], b + k
            want[i, j] = t / b
    assert media.resize(a, 4, 5) == pytest.approx(want)


def test_media_columns(spark, odd, empty):
    got = {r["doc_id"]: r for r in media.media_features(media.text_media(odd)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
    assert media.media_features(media.text_media(empty)).count() == 0
    tiles = media.image_tiles(media.text_media(odd).union(spark.createDataFrame([(77, 0, None), (78, 0, b"x")], "doc_id long, n_bytes long, media binary")), "doc_id").collect()
    assert [r["tile"] for r in tiles if r["doc_id"] in (77, 78)] == [None, None] and all(len(r["dhash"]) == 16 for r in tiles if r["tile"])


def test_media_that_is_none(spark):
    rows = [(1, 3, None), (2, 4, b"no image"), (3, 5, b"P5 99999999999999 9 255\n"), (4, 6, media.encode_pgm(np.full((2, 64), 7, np.uint8))), (None, None, b"P4 9999999999999999999999 1\n")]
    stored = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").selectExpr("*", "1 as tile", "2 as feature")
    got = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    assert got[1]["media_bytes"] is None and got[1]["media_sha256"] is None and got[2]["media_bytes"] == 8
    assert all(got[k]["payload_sha256"] is None and got[k]["tile"] is None for k in (1, 2, 3, None))
    assert got[4]["payload_bytes"] == 128 and np.load(__import__("io").BytesIO(got[4]["tile"])).shape == (32, 32)
    for bad in (b"P4\n99999999999999999999 3\n", b"P3 4000000000 4000000000 255 1", b"P2 2 2 99999999999999999999 1 2 3 4", b"BM" + b"\xff" * 60):
        assert media.decode(bad) is None


# -- 9
def test_short_items_are_whole_lines(spark):
    docs = spark.createDataFrame([(1, "Is water wet?"), (2, "so\nIs water wet\nyes"), (3, "tell me: is water wet or not"), (4, None), (5, "is\nwater\nwet"), (6, "yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "is water wet?"), (8, "..."), (9, None), (10, "Yes")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["n_same"], r["n_words"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 7, 0, 3, 3), (2, 7, 1, 3, 3), (2, 10, 4, 1, 1), (5, 7, 0, 3, 3), (6, 10, 0, 1, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [3, 4]


def test_masks_meet_every_tolerated_substitution():
    import itertools

    for n in range(10, 21):
        for gone in itertools.combinations(range(n), n // 5):
            assert any(all(p + o not in gone for o in m) for m in decontaminate.MASKS for p in range(n - m[-1])), (n, gone)


def test_decontamination(spark, odd, empty):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(10, 40)))) for i in range(30)]
    rows = []
    for i in range(150):
        ws = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        for _ in range(r.choice([0, 0, 1, 2])):
            it = r.choice(items)[1].split()
            for _ in range(r.randint(0, len(it) // 3)):
                it[r.randrange(len(it))] = r.choice(["zz", *vocabulary])
            at = r.randint(0, len(ws))
            ws[at:at] = it
        rows.append((i, " ".join(ws)))
    want = set()
    for d, t in rows:
        ws = t.split()
        for k, it in items:
            x = it.split()
            if any(100 * sum(a == b for a, b in zip(ws[p : p + len(x)], x)) >= 80 * len(x) for p in range(len(ws) - len(x) + 1)):
                want.add((d, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, "of the")], "item_id long, text string")
    for most in (decontaminate.BLOCK_WORDS, 200):
        got = {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(docs, bench, 80, most).collect() if x["first_word"] >= 0}
        assert want <= got and {d for d, _ in got} >= {d for d, _ in want}
        assert {x["doc_id"] for x in decontaminate.decontaminated(docs, bench, 80, most).collect()} == {d for d, _ in rows} - {x["doc_id"] for x in decontaminate.contaminated(docs, bench).collect()}
    assert {(d, k) for d, k in got if (d, k) not in want} == set()
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.decontaminated(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_parts_and_shifted_copies(spark):
    r = random.Random(6)
    item = {n: [f"i{n}x{k}" for k in range(n)] for n in (12, 40, 59, 500)}
    other = lambda n: [f"o{r.randrange(300)}" for _ in range(n)]
    put = lambda ws, *at: [x for k, w in enumerate(ws) for x in ([f"new{k}", w] if k in at else [w])]
    left = lambda ws, *at: [w for k, w in enumerate(ws) if k not in at]
    swap = lambda ws, *at: [f"new{k}" if k in at else w for k, w in enumerate(ws)]
    found = [item[500][100:350], item[59][:40], item[59][19:], item[500][460:], item[40][5:30]]
    found += [f(ws, len(ws) // 2) for ws in item.values() for f in (put, left)]
    found += [put(left(item[40], 9, 10), 20, 30), left(item[500], *range(7, 500, 9)), put(item[500][:60], *range(5, 60, 6)), left(item[12], 3, 8), put(swap(item[12], 4), 8)]
    clean = [item[500][:20], item[40][:20], item[12][:9], swap(item[40], *range(0, 40, 3)), put(item[40], *range(1, 40, 3)), left(item[500], *range(0, 500, 3)), item[59][:15] + other(30) + item[59][44:]]
    rows = [(k, " ".join(other(r.randint(0, 60)) + ws + other(r.randint(0, 60)))) for k, ws in enumerate(found + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(ws)) for n, ws in item.items()], "item_id long, text string")
    assert sorted(x["doc_id"] for x in decontaminate.contaminated(docs, bench).collect()) == list(range(len(found)))
    assert sorted(x["doc_id"] for x in decontaminate.decontaminated(docs, bench).collect()) == list(range(len(found), len(rows)))
    same = {x["doc_id"]: x["n_same"] for x in decontaminate.overlaps(docs, bench).collect()}
    assert same[0] == 250 and same[1] == 40 and same[5] == 12 and same[7] == 40 and same[8] == 39


def test_seeds_meet_every_tolerated_error():
    import itertools

    for n in range(5, 17):
        c = [f"w{k}" for k in range(n)]
        m = decontaminate.Matcher([(1, decontaminate.words(" ".join(c)))], 80)
        texts = []
        for at in itertools.combinations_with_replacement(range(n), n // 5):
            for kinds in itertools.product("sdi", repeat=n // 5):
                parts = [[w] for w in c]
                for k, kind in zip(at, kinds):
                    parts[k] = {"s": ["x"], "d": [], "i": ["x", *parts[k]]}[kind]
                texts.append(" ".join(w for x in parts for w in x))
        assert {d for d, *_ in m.find(texts)} == set(range(len(texts))), n


# -- 10
def test_license_scan(spark, empty):
    texts = [None, "", "CC-BY cc by. All rights reserved", "Licensed under the Apache License, Version 2.0. cc by-sa 4.0", "GNU General Public License, version 3; general public license", "É mit ümit MIT License x", "the gnu general public license as nothing", "cc by cc by cc by nc", "word " * 30000 + "BSD 3-clause license"]
    docs = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(texts)), (None, "CC BY", "y"), (2, texts[2], "x")], "doc_id long, text string, labels string")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) + 2
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in got:
        t = "CC BY" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
        base = [(k, label, c) for label, p, c in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        line, found = " " + " ".join(w) + " ", []
        for k, (label, priority, weight, gate, pattern) in enumerate(RULES):
            if gate in w:
                for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line, re.A):
                    first = line[: m.start()].count(" ") - 1
                    found.append((first, first + m[0].count(" "), (priority, m[0].count(" "), -k), label, weight))
        own = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] > x[2] for y in found)]
        places = [b[0] for b in base]
        assert tuple(r)[1:] == (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted({b[1] for b in base} | {x[3] for x in own})), max([0.0, *(b[2] for b in base), *(x[4] for x in own)])), t[:80]
    assert license_scan.scan(empty).count() == 0


def test_every_rule_holds_its_gate():
    assert len(RULES) >= 200
    for label, _, weight, gate, pattern in RULES:
        assert 0 < weight <= 1 and re.search(rf"(?<![a-z0-9]){gate}(?![a-z0-9])", re.sub(r"\?:|\\S|\\d", " ", pattern)), label


def matches(pattern):
    """Texts that the pattern matches, every choice taken and every repeat as often as its least and most (4 times at most)."""
    import itertools

    def of(tokens):
        return ["".join(x) for x in itertools.product(*map(one, tokens))]

    def one(token):
        op, arg = str(token[0]), token[1]
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return ["7"] if "CATEGORY_DIGIT" in str(arg) else ["x"] if "CATEGORY_NOT_SPACE" in str(arg) else [chr(x) for _, x in arg]
        if op == "MAX_REPEAT":
            return list({"".join(x) for n in {arg[0], min(arg[1], 4)} for x in itertools.product(of(arg[2])[:3], repeat=n)})
        if op == "SUBPATTERN":
            return of(arg[3])
        assert op == "BRANCH", op
        return [x for branch in arg[1] for x in of(branch)]

    return of(re._parser.parse(pattern))


def test_every_match_holds_its_gate():
    for label, _, _, gate, pattern in RULES:
        for text in matches(pattern):
            assert re.fullmatch(pattern, text) and gate in text.split(), (label, pattern, text)


def test_license_scan_without_gates(spark):
    names = ["gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "ofl"]
    versions = ["2", "3", "v2", "v3", "2.0", "v2.0", "1.0", "v1.0", "1", "v1", "1.1", "v1.1", "v1.2", "1.2", "v2.1", "3.0 only", "v2 only"]
    texts = [f"It is under {n.upper()}{s}{v} now" for n in names for v in versions for s in ("", " ", "-")] + ["for noncommercial use only", "for non-commercial use only"]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        line, found = " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " ", []
        for k, (label, priority, weight, _, pattern) in enumerate(RULES):
            found += [(m.start(), m.end(), (priority, m[0].count(" "), -k), label, weight) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line, re.A)]
        own = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] > x[2] for y in found)]
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted({x[3] for x in own})), max([0.0, *(x[4] for x in own)])), t
    label = {t: got[i]["labels"] for i, t in enumerate(texts)}
    for name, want in {"GPL2": "gpl-2.0", "GPLv2 only": "gpl-2.0", "GPL3": "gpl-3.0", "LGPL3": "lgpl-3.0", "AGPL3": "agpl-3.0", "MPL2": "mpl-2.0", "MPLv2.0": "mpl-2.0", "EPLv2.0": "epl-2.0", "CDDLv1.0": "cddl-1.0", "EUPLv1.2": "eupl-1.2", "OFLv1.1": "ofl-1.1"}.items():
        assert label[f"It is under {name} now"] == want


def longest_match(pattern):
    """Most words that a pattern can match, by its parse."""
    import re._parser as parser

    def most(tree):
        n = 0
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                n += chr(arg) == " "
            elif name == "BRANCH":
                n += max(most(x) for x in arg[1])
            elif name == "SUBPATTERN":
                n += most(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                inner = most(arg[2])
                n += inner * (int(arg[1]) if inner else 1)
        return n

    return most(parser.parse(pattern)) + 1


def test_no_pattern_is_longer_than_the_window():
    assert max(longest_match(r[4]) for r in RULES) <= license_scan.LONGEST


def test_license_scan_of_very_many_matches(spark):
    r = random.Random(2)
    signs = ["cc by", "cc by sa 4 0", "creative commons attribution", "gpl v2", "gnu general public license version 2", "mit license", "the mit license", "all rights reserved", "under the terms of the gnu general public license version 2 only", "word"]
    text = " ".join(r.choice(signs) for _ in range(700))
    line, found = f" {text} ", []
    for k, (label, priority, _, _, pattern) in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line, re.A):
            first = line.count(" ", 0, m.start()) - 1
            found.append((first, first + m[0].count(" "), (priority, m[0].count(" "), -k), label))
    own = {x[3] for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] > x[2] for y in found)}
    got = license_scan.scan(spark.createDataFrame([(1, text), (2, "cc by " * 20_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    starts = [line.count(" ", 0, m.start()) - 1 for p in ("cc by", "general public license", "all rights reserved") for m in re.finditer(f"(?<= ){p}(?= )", line)]
    base = {"cc-by", "gpl", "reserved"}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (len(starts), min(starts), max(starts)) and len(found) > 1000
    assert got[0]["labels"] == ",".join(sorted(own | base)) and got[0]["base_labels"] == "cc-by,gpl,reserved"
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (20_000, 0, 39_998)


# -- all
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    import duckdb

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test data")
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, at).toPandas(), duck.sql(queries.ORACLES[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# -- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    out = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        before = out
        out = stage(spark, before, at)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            assert out.exceptAll(before).count() == 0 or name == "mixing"
        if name == "near_dedup":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in brute(rows, 80).items() if i == c}
    assert out.count() == spark.read.parquet(f"{tmp_path}/3").count()
    assert cp.run(spark, at).count() == out.count()


def test_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "some words that are here more than once so that they count " * 2000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the same words stand here twice and again", "en", "a", 41), (4, "The same words stand here twice and again", "en", None, 41), (None, "no id here", "en", "b", 10), (5, long, "en", "b", len(long)), (6, "a benchmark item of nine words is in here", None, "b", 41), (6, "another text of the same id", None, "b", 27)]
    for name, part in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, "a benchmark item of nine words is in here"), (2, None)], "item_id long, text string"))):
        part.write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(cp.STAGES)
    run = lambda name, docs: stages[name](spark, docs, str(tmp_path))
    for docs, few in ((spark.createDataFrame(rows, schema), False), (spark.createDataFrame([], schema), True)):
        n = 0 if few else len(rows)
        assert run("toxicity", docs).count() == n
        kept = run("near_dedup", docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0 for r in kept.collect())) == ([] if few else [0, 1, 2, 3, 5, 6])
        clean = [r["text"] for r in run("decontamination", docs).collect()]
        assert len(clean) == max(0, n - 1) and rows[6][1] not in clean
        mixed = run("mixing", docs)
        assert mixed.columns == docs.columns and {r["text"] for r in mixed.collect()} <= {r[1] for r in rows}
        assert run("token_output", docs).count() == n
