"""Loading and saving datasets, and tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parflow.operators.dataset import Dataset


def load(spark: SparkSession, url: str) -> Dataset:
    """``scheme://path``. ``unix://`` reads one whole file as one element; ``text://`` lines; ``parquet://``, ``csv://``,
    ``json://`` and ``orc://`` tables. One logical copy, whatever the number of workers. Other schemes raise ValueError."""
    scheme, sep, path = url.partition("://")
    if not sep:
        raise ValueError(f"no scheme in {url!r}")
    if scheme == "unix":
        return Dataset(spark.read.text(path, wholetext=True))
    if scheme == "bytes":
        return Dataset(spark.read.format("binaryFile").load(path).select(F.col("content").alias("value")))
    if scheme == "text":
        return Dataset(spark.read.text(path))
    if scheme in ("parquet", "json", "orc"):
        return Dataset(spark.read.format(scheme).load(path))
    if scheme == "csv":
        return Dataset(spark.read.csv(path, inferSchema=True))
    raise ValueError(f"unknown system {scheme!r}")


def save(ds: Dataset, url: str) -> int:
    """Write all rows, replacing what is there; the lazy plan runs. Returns the bytes written."""
    scheme, _, path = url.partition("://")
    df = ds.df
    spark = df.sparkSession
    if scheme in ("unix", "text"):
        df.select(F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)
    elif scheme in ("parquet", "json", "orc", "csv"):
        df.write.mode("overwrite").format(scheme).save(path)
    else:
        raise ValueError(f"unknown system {scheme!r}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only in local mode may it be unset: then it is a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="parflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Cut the lineage by a table in the shared folder; it outlives the loss of executors."""
    at = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`materialise`."""
    spark = df.sparkSession
    for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
