"""Operator 10: license scan by ordered signature rules. DataFrame functions only.

One pass over a text tells whether any rule's gate word may be in it; only then is it put into lower-case words joined by
single spaces, the gates found in it select rules, and these give detections: label, priority, weight, first and last word.
A detection that another contains is suppressed if that one has the higher priority, or an equal one and is longer, or is as
long and of an earlier rule. The base phrases' labels are never suppressed. No shuffle; a row is worked off by itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, GATES, RULES

#: A word in text whose letters are of either case.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: No pattern matches more words than this (a test tells).
LONGEST = 64
#: Elements in a block of a long list.
STEP = 64
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gate_pattern() -> str:
    """Any gate as a whole word, in either case; words are grouped by first letter, so most places fail at once."""
    by: dict[str, list[str]] = {}
    for g in GATES:
        by.setdefault(g[0], []).append(g[1:])
    first = "".join(by)
    groups = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by.items())
    inner = ANY_WORD[1:-2]
    return f"(?i)(?<![^{inner[1:]}])(?=[{first}])(?:{groups})(?![^{inner[1:]}])"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def literals(values: Iterable[str]) -> Column:
    """An array of SQL literals: parsed at once, as there are hundreds."""
    return F.expr(f"array({', '.join(values)})")


def total(a: Column, start: Column, n: Column) -> Column:
    """Sum of n elements after the first ``start``."""
    return F.aggregate(F.slice(a, start + 1, n), F.lit(0), lambda x, y: x + y)


def div(i: Column, n: int) -> Column:
    return F.floor(i / n).cast("int")


def block_sums(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), div(F.size(a), STEP)), lambda b: total(a, b * STEP, F.lit(STEP)))


def matches(words: Column) -> Column:
    """(rule, i, before, more): of each rule that its gate selects, and each of its matches, the words since the match before
    and the further words in it. Base phrases come as rules numbered from ``len(RULES)``."""
    every = [(g, p) for _, _, _, g, p in RULES] + [(p, p) for _, p, _ in BASE]
    rules = literals(f"named_struct('rule', {k}, 'gate', ' {g} ', 'pattern', r'(?<= )(?:{p})(?= )')" for k, (g, p) in enumerate(every))
    held = F.filter(rules, lambda r: words.contains(r["gate"]))
    got = F.transform(held, lambda r: F.struct(r["rule"].alias("rule"), F.split(words, r["pattern"], -1).alias("p"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("m")))
    return F.flatten(F.transform(got, lambda g: F.transform(g["m"], lambda m, i: F.struct(g["rule"].alias("rule"), i.alias("i"), spaces(F.get(g["p"], i)).alias("before"), spaces(m).alias("more")))))


def detections(rows: DataFrame) -> DataFrame:
    """Turn ``matches`` into ``found`` (first, last, rule): places in words are sums over all matches so far, less what they were where the
    rule's matches begin. The sums are made in blocks of ``STEP`` and blocks of blocks, so a text with very many matches takes a
    few short sums for each. Every step is a column of its own, as nested functions are slow to plan."""
    keep = [c for c in rows.columns if c != "matches"]
    rows = rows.select(*keep, "matches", F.transform("matches", lambda x: x["before"] + x["more"]).alias("sizes"))
    rows = rows.select(*keep, "matches", "sizes", block_sums(F.col("sizes")).alias("blocks"))
    rows = rows.select(*keep, "matches", "sizes", "blocks", block_sums(F.col("blocks")).alias("supers"))
    b, c = (lambda i: div(i, STEP)), (lambda i: div(i, STEP * STEP))
    upto = lambda x, i: total(F.col("supers"), F.lit(0), c(i)) + total(F.col("blocks"), c(i) * STEP, b(i) - c(i) * STEP) + total(F.col("sizes"), b(i) * STEP, i - b(i) * STEP)
    rows = rows.select(*keep, "matches", F.transform("sizes", upto).alias("upto"))
    begins = F.filter(F.zip_with("matches", "upto", lambda m, n: F.struct(m["rule"].alias("rule"), m["i"].alias("i"), n.alias("n"))), lambda x: x["i"] == 0)
    rows = rows.select(*keep, "matches", "upto", F.map_from_entries(F.transform(begins, lambda x: F.struct(x["rule"].alias("rule"), x["n"].alias("n")))).alias("begins"))
    place = lambda m, n: n - F.element_at("begins", m["rule"]) + m["before"] - 1
    return rows.select(*keep, F.zip_with("matches", "upto", lambda m, n: F.struct(place(m, n).cast("long").alias("first"), (place(m, n) + m["more"]).cast("long").alias("last"), m["rule"].alias("rule"))).alias("found"))


def of(rule: Column, field: int, base: int) -> Column:
    """A field of the rule, or the base phrase, with this number."""
    values = [r[field] for r in RULES] + [r[base] for r in BASE]
    return F.element_at(literals(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values), rule + 1)


def unsuppressed(rows: DataFrame) -> DataFrame:
    """``own``: those of ``found`` that no other suppresses. One that contains another begins at most ``LONGEST`` words before it, so in a
    long list, put in order, only such neighbours are compared."""

    def beats(e: Column, d: Column) -> Column:
        size = lambda x: x["last"] - x["first"]
        order = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & ((size(e) > size(d)) | ((size(e) == size(d)) & (e["rule"] < d["rule"]))))
        return (e["first"] <= d["first"]) & (e["last"] >= d["last"]) & order

    def below(x: Column) -> Column:
        """How many begin before word x, by bisection."""
        less = lambda n: F.coalesce(F.get("firsts", n - 1) < x, F.lit(False))
        return F.aggregate(F.array(*(F.lit(1 << b) for b in reversed(range(28)))), F.lit(0), lambda n, half: F.when((half <= F.size("firsts") - n) & less(n + half), n + half).otherwise(n))

    keep = rows.columns
    one = lambda d: F.struct(d["first"].alias("first"), d["last"].alias("last"), d["rule"].alias("rule"), F.element_at(literals(str(r[1]) for r in RULES), d["rule"] + 1).alias("priority"))
    rows = rows.select(*keep, F.array_sort(F.transform(F.filter("found", lambda d: d["rule"] < len(RULES)), one)).alias("order"))
    # not order["first"], which the optimizer would put in place of each use
    rows = rows.select(*keep, "order", F.transform("order", lambda d: d["first"]).alias("firsts"))
    rank = lambda d: F.struct(d["priority"], d["last"] - d["first"], -d["rule"])
    rows = rows.select(*keep, "order", "firsts", F.array_max(F.transform("order", rank)).alias("best"))
    spans = F.transform("order", lambda d: F.when(rank(d) < F.col("best"), F.struct(below(d["first"] - LONGEST).alias("low"), below(d["first"] + 1).alias("high"))))  # none beats the best
    rows = rows.select(*keep, "order", F.when(F.size("order") > STEP, spans).alias("spans"))
    short = F.filter("order", lambda d: ~F.exists("order", lambda e: beats(e, d)))
    near = lambda x: F.slice("order", x["low"] + 1, x["high"] - x["low"])
    long = F.filter("order", lambda d, i: F.get("spans", i).isNull() | ~F.exists(near(F.get("spans", i)), lambda e: beats(e, d)))
    return rows.select(*keep, F.when(F.col("spans").isNull(), short).otherwise(long).alias("own"))


def scan(docs: DataFrame) -> DataFrame:
    """License signs of every whole text: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    A null text counts as empty: no words, no labels, score 0. A null doc_id stays; repeated rows are scanned each; other
    columns are not looked at. Time grows with the text and its matches, not with their square.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.concat(F.lit(" "), F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NO_WORD, " "), F.lit(" "))
    words = F.regexp_replace(words, "^ +| +$", " ")
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(gate_pattern()), words).alias("words"))
    rows = rows.select("doc_id", "n_words", matches(F.col("words")).alias("matches"))
    rows = unsuppressed(detections(rows))
    rows = rows.select("doc_id", "n_words", "own", F.filter("found", lambda d: d["rule"] >= len(RULES)).alias("base"))
    b, o = F.col("base"), F.col("own")
    numbers = F.array_distinct(F.concat(b["rule"], o["rule"]))
    joined = lambda a: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda r: of(r, 0, 0)))), ","), F.lit(""))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(b.isNull(), 0).otherwise(F.size(b)).cast("long").alias("n_base"),
        F.array_min(b["first"]).alias("first_word"),
        F.array_max(b["first"]).alias("last_word"),
        joined(F.array_distinct(b["rule"])).alias("base_labels"),
        joined(numbers).alias("labels"),
        F.coalesce(F.array_max(F.transform(numbers, lambda r: of(r, 2, 2))), F.lit(0.0)).alias("score"),
    )
