"""Session helpers: inputs, the shared folder, and bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names, whatever else the table has; null text is empty."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one becomes it on a local master; on a
    cluster, whose machines do not share such a folder, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends if not before."""
    path = f"{shared_dir(spark)}/quillspark/{what}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors.

    The files are removed by discard(), or when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table whose consumers have been written."""
    _drop(df.sparkSession, df.stored_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; its owner clears the folder
        pass


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of a slim table."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is stored and has at most `rows` rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def filtered(docs: DataFrame, text: str, keep) -> DataFrame:
    """The rows of `docs`, all columns, that keep(batches, name of the text column) yields: one pass, no shuffle.

    Columns travel under plain names, so that names with dots are no trouble.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = f"c{docs.columns.index(text)}"
    return plain.mapInArrow(lambda batches: keep(batches, name), plain.schema).toDF(*docs.columns)
