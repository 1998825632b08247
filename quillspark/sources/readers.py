"""Files into DataFrames: JSON with fixed schemas, keyed JSON objects, sheets, binaries, inline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from quillspark.sources.schemas import SCHEMAS


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rows numbered in reading order: increasing, with gaps between partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def json_entities(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """A JSON array (or object) of an entity. No inference; the array's position is kept as `ord`."""
    return with_ordinal(spark.read.schema(SCHEMAS[entity]).json(path, multiLine=True))


def optional_json(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The same, or no rows if the file is absent."""
    return json_entities(spark, path, entity) if exists(spark, path) else with_ordinal(spark.createDataFrame([], SCHEMAS[entity]))


def keyed_json(spark: SparkSession, path: str, entry: str, key: str) -> DataFrame:
    """A JSON object of entries by key as rows."""
    kind = MapType(StringType(), StructType.fromDDL(SCHEMAS[entry]))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return whole.select(F.explode("m").alias(key, "e")).select(key, "e.*")


def items(value: Column, item: str) -> Column:
    """Elements of a JSON list, or of the list under `items` of a JSON object."""
    kind = ArrayType(StructType.fromDDL(item))
    # an object read as a list would be a list of itself
    whole = F.when(F.ltrim(value).startswith("["), value).otherwise(F.get_json_object(value, "$.items"))
    return F.from_json(whole, kind)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with header; every column is a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return with_ordinal(spark.createDataFrame(rows, schema))


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def pdfs(files: DataFrame) -> DataFrame:
    """Payloads that start as a PDF does."""
    return files.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose name and length the mirror does not have yet."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).join(known.select("name", "length"), ["name", "length"], "left_anti")


def probe(files: DataFrame, extensions: list[str]) -> DataFrame:
    """(slug, path): for each name without extension the file of the first extension in the list."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    rank = F.array_position(F.array(*map(F.lit, extensions)), ext)
    found = files.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("slug"), rank.alias("r")).where("r > 0")
    return found.groupBy("slug").agg(F.min_by("path", "r").alias("path"))


def env_pairs(text: str, have: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a k=v file: no blanks, comments or lines without '='; quotes go; settings one has stay."""
    out = dict(have or {})
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out.setdefault(k.strip(), v.strip().strip("\"'"))
    return out
