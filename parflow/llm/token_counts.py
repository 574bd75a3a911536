"""Operator 2: token counts. Pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies and summed; ids are never kept.

A pre-token here is a unit cut before each space that a non-space follows. The tokenizer's own pre-tokeniser always cuts there,
so pieces never cross units. A new unit is split by the pre-tokeniser's pattern, and only pieces not met before go through the
merge table. The table of counts lives in the Python worker, is bounded by ``UNITS`` entries and is begun anew when full, so
what is counted never depends on it. Texts outside what the pattern is known to cut alike go whole through the library.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Entries of a worker's table of counts.
UNITS = 400_000
#: Longer units and pieces are counted anew each time, so the table is bounded in bytes too.
KEPT_CHARS = 64
#: Outside these, or where a special token's string may stand, the library takes the whole text.
PLAIN = "\t\n\r -~\xa1\xa7\xab\xac\xae\xb0\xb1\xb4\xb6\xb7\xbb\xbf-ſ‐-―‘-‟•…€"
ODD = re.compile(f"[^{PLAIN}]|<\\|")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNEVEN = re.compile(r" (?=\s|\Z)")
CUT = re.compile(r"(?= \S)")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts_as_known(file: dict) -> bool:
    """Whether a tokenizer file cuts texts by the byte-level pattern that this module counts by; others go through the library."""
    cut = file.get("pre_tokenizer") or {}
    return file.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and file["model"].get("type", "BPE") == "BPE"


class Counts:
    """Pieces by unit, for one tokenizer file."""

    kept: dict[str, Counts] = {}

    def __init__(self, path: str) -> None:
        self.library = load(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            self.plain = cuts_as_known(json.load(f))
        self.units: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counts:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def unit(self, unit: str) -> int:
        total = 0
        for p in PIECES.findall(unit):
            n = self.pieces.get(p)
            if n is None:
                n = len(self.model.tokenize(letters(p)))
                if len(p) <= KEPT_CHARS and len(self.pieces) < UNITS:
                    self.pieces[p] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.plain or ODD.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if len(self.units) > UNITS:
            self.units, self.pieces = {}, {}
        if UNEVEN.search(text):
            first, *rest = CUT.split(text)
            rest = [u[1:] for u in rest]
        else:
            first, *rest = text.split(" ")
        freq, known = Counter(rest), self.units
        long = 0
        for u in [u for u in freq if u not in known]:
            if len(u) <= KEPT_CHARS:
                known[u] = self.unit(" " + u)
            else:
                long += self.unit(" " + u) * freq.pop(u)
        return self.unit(first) + long + sum(map(mul, map(known.__getitem__, freq), freq.values()))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    ``path`` is a byte-level ``.json`` tokenizer, found there on every executor. A null text counts as empty, with 0 tokens.
    Other columns are not looked at; a null doc_id stays null; repeated rows are counted each. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = [counts.count(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
