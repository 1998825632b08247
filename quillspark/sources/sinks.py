"""Writes with the failure rules of the harvest: whole or not at all, and never worse than what is there."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.readers import exists


def _fs(df_or_spark, path: str):
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """`new` takes the place of `path` by renames. What was there stays until then, and comes back if the rename fails."""
    (to, fs), (source, _), (old, _) = _fs(spark, path), _fs(spark, new), _fs(spark, f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(source, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(old, True)


def json_atomic(df: DataFrame, path: str) -> None:
    """JSON with sorted fields. Written beside `path` and moved there when all of it is: a job that fails leaves `path`
    as it was."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    try:
        df.select(*sorted(df.columns)).write.json(new)
        replace_folder(df.sparkSession, new, path)
    finally:
        at, fs = _fs(df, new)
        fs.delete(at, True)


def keep_previous(df: DataFrame, path: str, write=json_atomic) -> bool:
    """Overwrites only if there are rows or nothing is there yet; says whether it wrote."""
    if df.limit(1).count() == 0 and exists(df.sparkSession, path):
        return False
    write(df, path)
    return True


class QualityError(RuntimeError):
    pass


def gate_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that fail each check (a NULL check fails)."""
    return df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()], F.count("*").alias("rows"))


def quality_gate(df: DataFrame, checks: dict[str, Column], least_rows: int = 1) -> None:
    """Raises with all failed checks; nothing is to be written then."""
    r = gate_counts(df, checks).first()
    bad = [f"{n}: {r[n]} rows" for n in checks if r[n]]
    if r["rows"] < least_rows:
        bad.append(f"{r['rows']} rows, {least_rows} needed")
    if bad:
        raise QualityError("; ".join(bad))


def single_file(pages: DataFrame, order: list[str], content: str) -> DataFrame:
    """All pages in order as one string (one row): meant for a site's pages, not for a corpus."""
    fields = [F.col(c) for c in order]
    return pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields, content))), lambda s: s[content]), "").alias(content))


def rendered(pages: DataFrame, path: Column, content: Column) -> DataFrame:
    """(path, content) rows, the form in which pages are handed to a writer."""
    return pages.select(path.alias("path"), content.alias("content"))


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each content to its path below a folder that all executors reach; (path, bytes) of what was written.

    A file appears whole or not at all, and a task that runs twice writes the same files. Paths that lead out of the folder
    are an error. Of rows that repeat a path one is written: the greatest content.
    """
    once = pages.groupBy("path").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path is None or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path!r} leads out of {folder}")
                to, raw = f"{root}/{path}", content.encode()
                system.create_dir(to.rpartition("/")[0], recursive=True)
                new = f"{to}.new-{uuid.uuid4().hex}"
                with system.open_output_stream(new) as f:
                    f.write(raw)
                system.move(new, to)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return once.mapInArrow(write, "path string, bytes long")


def reset_site(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Empties a folder but for the names in `keep`, making it if need be; the names that went."""
    at, fs = _fs(spark, folder)
    fs.mkdirs(at)
    gone = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName() not in keep)
    for name in gone:
        fs.delete(_fs(spark, f"{folder}/{name}")[0], True)
    return gone
