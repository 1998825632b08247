"""Month series, usage totals and the submission funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.dates import month_of


def monthly_timeline(df: DataFrame, keys: list[str], date: str = "date", label: str = "label", value: str = "value") -> DataFrame:
    """Sum per month. The date comes from `date`, else from `label`; rows without month or whole number are skipped."""
    ym = month_of(F.coalesce(F.nullif(F.col(date), F.lit("")), F.col(label)))
    n = F.col(value).try_cast("bigint") if dict(df.dtypes)[value] != "string" else F.when(F.col(value).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("bigint"))
    return df.withColumn("ym", ym).withColumn("__n", n).where("ym IS NOT NULL AND __n IS NOT NULL").groupBy(*keys, "ym").agg(F.sum("__n").alias("value"))


def series_total(months: Column) -> Column:
    return F.aggregate(F.map_values(months), F.lit(0).cast("long"), lambda a, x: a + x)


def exclude(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def funnel_status(df: DataFrame, status: Column, published, declined) -> DataFrame:
    """One row: published, declined and underReview (everything else, NULL too), and the total; empty buckets are 0."""
    done = F.coalesce(status.isin(published, declined), F.lit(False))
    return df.agg(F.count_if(status == published).alias("published"), F.count_if(~done).alias("underReview"), F.count_if(status == declined).alias("declined"), F.count("*").alias("total"))


def shares(counts: DataFrame, order: list[str]) -> DataFrame:
    """Buckets of a one-row count table as rows: ord, bucket, n, pct of their sum. Empty buckets are left out."""
    total = sum((F.col(c) for c in order[1:]), F.col(order[0]))
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("bucket"), F.col(c).alias("n"), (F.lit(100.0) * F.col(c) / F.greatest(total, F.lit(1))).alias("pct")) for i, c in enumerate(order)])
    return counts.select(F.inline(rows)).where("n > 0")


def views_total(a: Column, b: Column) -> Column:
    """Sum of two counts; NULL only if both are."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def views_breakdown(a: Column, b: Column, first: str, second: str) -> Column:
    return F.concat_ws(" · ", F.concat(a.cast("string"), F.lit(f" {first}")), F.concat(b.cast("string"), F.lit(f" {second}")))


def hits_rollup(keys: DataFrame, hits: DataFrame, key: str, month: str = "ym", count: str = "count") -> DataFrame:
    """Total and months of every key; counts of 0 are not kept, keys without hits have 0 and an empty map."""
    per = hits.where(F.col(count) > 0).groupBy(key, month).agg(F.sum(count).alias("n"))
    rolled = per.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(month, "n")))).alias("months"))
    out = keys.join(rolled, key, "left")
    return out.withColumns({"total": F.coalesce("total", F.lit(0)), "months": F.coalesce("months", F.create_map().cast("map<string,bigint>"))})


def coverage(rolled: DataFrame) -> DataFrame:
    return rolled.agg(F.count_if(F.col("total") > 0).alias("covered"), F.count("*").alias("keys"))


def from_month(points: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Points from the key's own first month on; a key without one keeps all."""
    joined = points.join(starts.select(key, F.col("start_ym").alias("__start")), key, "left")
    return joined.where("__start IS NULL OR ym >= __start").drop("__start")


def line_points(points: DataFrame, keys: list[str], width: float = 256, height: float = 96, axis: float = 30, label: float = 14) -> DataFrame:
    """Chart coordinates of each point of a series; series of one month have none."""
    from quillspark.functions.numbers import scale_x, scale_y

    by = W.partitionBy(*keys)
    df = points.withColumn("i", F.row_number().over(by.orderBy("ym")) - 1).withColumn("n", F.count("*").over(by)).withColumn("peak", F.greatest(F.max("value").over(by), F.lit(1)))
    df = df.where("n >= 2")
    return df.select(*keys, "ym", "value", scale_x(F.col("i"), F.col("n"), axis + 4, width - 6).alias("x"), scale_y(F.col("value"), F.col("peak"), height - label).alias("y"))


def bars(points: DataFrame, keys: list[str], width: float = 280, height: float = 90, axis: float = 30, label: float = 14) -> DataFrame:
    """Bar geometry of each point; only months that occur have a place."""
    from quillspark.functions.numbers import bar_height, bar_width

    by = W.partitionBy(*keys)
    df = points.withColumn("i", F.row_number().over(by.orderBy("ym")) - 1).withColumn("n", F.count("*").over(by)).withColumn("peak", F.greatest(F.max("value").over(by), F.lit(1))).where("n >= 2")
    group, wide = F.lit(width - axis) / F.col("n"), bar_width(F.col("n"), width - axis)
    tall = F.lit(height - label) * F.col("value") / F.col("peak")
    return df.select(*keys, "ym", "value", (F.lit(axis) + F.col("i") * group + (group - wide) / 2).alias("x"), (F.lit(height - label) - tall).alias("y"), wide.alias("w"), bar_height(F.col("value"), F.col("peak"), height - label).alias("h"))
