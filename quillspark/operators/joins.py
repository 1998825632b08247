"""Joins with explicit rules for misses and duplicates.

No side is broadcast by hint: Spark broadcasts what its statistics show to be small, and AQE splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark guesses a frame's size from its files, not from what the rows became."""
    return df.hint("merge")


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the last by `order`: one aggregation with map-side combine, no sort of whole groups."""
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def _pick(df: DataFrame, keys: list[str], order: list, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("r"))
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def left_default(left: DataFrame, right: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Left outer join; an empty key matches nothing, and misses get the defaults."""
    key = F.nullif(left[on], F.lit("")) if dict(left.dtypes)[on] == "string" else left[on]
    out = left.withColumn("__key", key).join(right.withColumnRenamed(on, "__right"), F.col("__key") == F.col("__right"), "left").drop("__key", "__right")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def outer_series(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum of two series over all keys of either; a missing point counts as 0."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    return both.select(*keys, (F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).alias(value))


def merge_maps(a: Column, b: Column) -> Column:
    """The same for two maps of month to number."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def cascade(keys: DataFrame, on: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Values of the first source, and of the second one for keys that the first lacks; keys of neither get NULL."""
    names = [c for c in first.columns if c != on]
    one = first.select(F.col(on).alias("__k1"), F.struct(*names).alias("__v1"))
    two = second.select(F.col(on).alias("__k2"), F.struct(*names).alias("__v2"))
    both = keys.join(one, keys[on] == F.col("__k1"), "left").join(two, (keys[on] == F.col("__k2")) & F.col("__k1").isNull(), "left")
    value = lambda c: F.when(F.col("__k1").isNotNull(), F.col("__v1")[c]).otherwise(F.col("__v2")[c]).alias(c)
    return both.select(*[keys[c] for c in keys.columns], *[value(c) for c in names])


def dangling(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows whose key the other side lacks."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def label_override(items: DataFrame, overrides: DataFrame, labels: DataFrame, on: str = "path") -> DataFrame:
    """Label of an item: the override, else the given label, else the item goes."""
    named = items.join(overrides.select(on, F.col("label").alias("__o")), on, "left").join(labels.select(on, F.col("label").alias("__l")), on, "left")
    return named.withColumn("label", F.coalesce("__o", "__l")).drop("__o", "__l").where("label IS NOT NULL")


def nest(parent: DataFrame, child: DataFrame, on: str, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """Children of each parent as an array in the given order; a parent without children has an empty one."""
    ranked = child.withColumn("__rank", F.row_number().over(W.partitionBy(on).orderBy(*order)))
    lists = ranked.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("__rank", *fields))).alias(name))
    lists = lists.select(on, F.transform(name, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))
    out = parent.join(lists, on, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
