"""Operator 5: token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A shard is ``part-*.rec``. Each record is framed as: payload length (8 bytes), masked checksum of those 8 bytes (4), payload,
masked checksum of the payload (4), all little-endian; the checksum is CRC-32 (zlib's), masked by a rotation and a constant so
that checksums of data that hold checksums stay sound. The payload is the serialized sequence: doc_id (8 bytes), whether
doc_id is null (1), bytes per id (1: 2 or 4), number of ids (4), the ids. Beside it lies ``part-*.idx``: the offset of each
record as 8 bytes, so any record is read by one seek.

Documents are range-partitioned by id; each task encodes one range and writes one shard under a name of its own, so a repeated
or speculative task never spoils a shard: only shards listed in the manifest count. Starts are sums over the manifest, which
has one row a shard.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, slices
from .token_counts import LETTERS, ODD, letters, load

#: Bytes of text for one shard.
SHARD_BYTES = 16 << 20
#: Id written after each document.
END = 1
#: Bytes of text that are encoded together; with the tables below it bounds a worker's memory.
SLICE = 1_000_000
#: Entries and characters of a worker's table of units, and of that of pieces.
UNITS = 300_000
CHARS = 32 * UNITS
#: Pieces of units that stand one a line; the line feeds between units are found too.
PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: What a tokenizer file must say for that.
LAST = "</w>"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qBBI")
SUM = struct.Struct("<I")


def cuts_as_known(file: dict) -> bool:
    """Whether a tokenizer file cuts texts as ``PIECES`` does and marks each piece's last id; others go through the library."""
    model = file["model"]
    if (file.get("normalizer"), file.get("pre_tokenizer")) != (NORMALIZER, PRE_TOKENIZER) or model.get("type") != "BPE" or model.get("end_of_word_suffix") != LAST:
        return False
    return not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")) and all(c + end in model["vocab"] for c in LETTERS.values() for end in ("", LAST))


def gather(flat: array, starts: array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``flat`` laid end to end, and where each ends."""
    bounds = np.asarray(starts)
    begin = bounds[at]
    n = bounds[at + 1] - begin
    ends = np.cumsum(n)
    places = np.repeat(begin - (ends - n), n)
    places += np.arange(len(places))
    return np.asarray(flat)[places], ends


class Ids:
    """Ids by white-space delimited unit, for one tokenizer file; bounded by ``UNITS`` entries and ``CHARS`` characters, then begun anew.

    Arrow cuts a batch of texts into units, and each distinct one is looked up once. Units not met before are cut into pieces by
    one search, and pieces not met before go through the merge table in one call; ids that end with ``LAST`` tell where each piece ends.
    """

    kept: dict[str, Ids] = {}

    def __init__(self, path: str) -> None:
        self.library = load(path)
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.plain = cuts_as_known(file)
        if self.plain:
            self.merges = Tokenizer(self.library.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = file["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(LAST)]] = True
        self.clear()
        self.clear_pieces()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.flat, self.starts, self.chars = array("I"), array("q", [0]), 0

    def clear_pieces(self) -> None:
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_flat, self.piece_starts, self.piece_chars = array("I"), array("q", [0, 0]), 0

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def add(self, units: list[str]) -> None:
        if len(self.pieces) > UNITS or self.piece_chars > CHARS:
            self.clear_pieces()
        joined = "\n".join(units).lower()
        self.chars += len(joined)
        found = PIECES.findall(joined)
        fresh = [p for p in dict.fromkeys(found) if p not in self.pieces]
        if fresh:
            lines = letters("\n".join(fresh)).replace(LETTERS[10], "\n")
            self.piece_chars += len(lines)
            ids = np.array(self.merges.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            self.piece_starts.frombytes((np.flatnonzero(self.last[ids]) + 1 + len(self.piece_flat)).tobytes())
            self.piece_flat.frombytes(ids.tobytes())
            self.pieces.update(zip(fresh, range(len(self.pieces), len(self.pieces) + len(fresh))))
        at = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        ids, ends = gather(self.piece_flat, self.piece_starts, at)
        self.starts.frombytes((np.append(ends[at == 0], len(ids)) + len(self.flat)).tobytes())
        self.flat.frombytes(ids.tobytes())
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units))))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each whole text's ids as the library gives them; null as empty. ``SLICE`` bytes are worked off at a time, or one text."""
        for part in slices(pa.record_batch([texts], ["text"]), "text", SLICE):
            yield from self.encode_slice(part.column("text"))

    def encode_slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD.pattern) if self.plain else pa.array([True] * len(texts), pa.bool_())
        if len(self.units) > UNITS or self.chars > CHARS:
            self.clear()
        units = pc.ascii_split_whitespace(texts.filter(pc.invert(odd)))
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.units.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.units) + np.arange(len(new))
            self.add(words[new].tolist())
        ids, ends = gather(self.flat, self.starts, at[coded.indices.to_numpy()])
        cuts = iter(np.append(0, ends)[units.offsets.to_numpy()].tolist())
        begin = next(cuts)
        for k, through in enumerate(odd.to_pylist()):
            if through:
                yield np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                end = next(cuts)
                yield ids[begin:end]
                begin = end

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = BODY.pack(doc_id or 0, doc_id is None, 4 if wide else 2, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
    n = struct.pack("<Q", len(body))
    return n + SUM.pack(masked(n)) + body + SUM.pack(masked(body))


class Reader:
    """Records of a shard, one after another or, by ``at``, any one."""

    def __init__(self, path: str) -> None:
        system, name = file_system(path)
        self.file = system.open_input_file(name)

    def next(self) -> tuple[int | None, np.ndarray] | None:
        head = self.file.read(12)
        if not head:
            return None
        n, check = HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("length checksum")
        body, check = self.file.read(n), SUM.unpack(self.file.read(4))[0]
        if masked(body) != check:
            raise ValueError("record checksum")
        doc_id, none, width, count = BODY.unpack_from(body)
        return None if none else doc_id, np.frombuffer(body, f"<u{width}", count, BODY.size)

    def at(self, offset: int) -> tuple[int | None, np.ndarray] | None:
        self.file.seek(offset)
        return self.next()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as executors see it; Hadoop's names of object stores are taken too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)) if ":" in path else f"file://{path}")


def offsets(path: str) -> np.ndarray:
    """The index beside a shard."""
    system, name = file_system(path.removesuffix(".rec") + ".idx")
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read(), "<u8")


def write(docs: DataFrame, tokenizer: str, at: str, shards: int | None = None) -> DataFrame:
    """Write all documents under ``at`` in ascending doc_id order; returns the manifest (shard, path, n_docs, n_tokens, start).

    A null text is written as the end id alone; a null doc_id comes first; rows of one id are written each, in order of text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, system, path, n, total, index = Ids.of(tokenizer), None, "", 0, 0, []
        for batch in batches:
            if batch.num_rows and system is None:
                path = f"{at}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.rec"
                system, name = file_system(path)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                out, where = system.open_output_stream(name), 0
            for d, x in zip(batch.column("doc_id").to_pylist(), ids.encode_all(batch.column("text"))):
                x = np.append(x, np.uint32(END))
                body = record(d, x)
                out.write(body)
                index.append(where)
                where, n, total = where + len(body), n + 1, total + len(x)
        if system is not None:
            out.close()
            with system.open_output_stream(name.removesuffix(".rec") + ".idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [n], "n_tokens": [total]})

    ordered = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = materialise(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("start", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Read the shards back: (doc_id, start, n_tokens, ids_crc32), with every checksum verified."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    kinds = [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                reader, rows = Reader(path), []
                while (got := reader.next()) is not None:
                    doc_id, ids = got
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("shard", "path", "start").repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all of ``docs`` and read the files back. Empty tables write nothing and give no rows."""
    return read(write(docs, tokenizer, scratch(docs.sparkSession, "tokens")))
