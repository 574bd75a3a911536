"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are worked off in slices of about this many characters.
SLICE_CHARS = 4_000_000
#: Bits of the largest screen, as a power of two.
SCREEN_BITS = 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only in local mode, where one machine does all, may it be
    unset: then it is a folder of our own. On a cluster that is an error, as no machine's own folder is seen by the others."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="parflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = scratch(spark, tag)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def delete(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`materialise`."""
    for df in tables:
        spark = df.sparkSession
        for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def screen(df: DataFrame, column: str, keys: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the first column of ``keys``; with ``inside=False`` those that surely are not.

    A Bloom filter of one hash as rows of 4 KB bitmaps, broadcast before the shuffle that the exact join needs. It is sized by a
    count of the keys, up to ``SCREEN_BITS``: 32 MB at most. With more keys it fills up and lets more rows through, so results never depend on it.
    Nulls are not among keys.
    """
    need = 16 * max(1, keys.count())
    bits = 1 << min(SCREEN_BITS, max(15, (need - 1).bit_length()))
    bucket, held_bits = own_name(df, "bucket"), own_name(df, "bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = keys.select(place(F.col(keys.columns[0]).cast("long")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(held_bits))
    c = F.col(column).cast("long")
    at = F.bitmap_bit_position(place(c))
    byte = F.conv(F.hex(F.substring(F.col(held_bits), (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int"))) > 0, F.lit(False)) & c.isNotNull()
    rows = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(c)) == F.col(bucket), "inner" if inside else "left")
    return rows.filter(held if inside else ~held).select(*(df[x] for x in df.columns))


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, one row at least: memory is bounded by that and the longest text."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: The six ASCII white-space characters, as Java and RE2 patterns write them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
