"""Funnel and series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import joins, series
from quillspark.plans.tables import table

EXCLUDED = (1, 7, 32, 100)
_NOT = "o_orderkey NOT IN (1, 7, 32, 100)"


def _orders(spark, sf_dir) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in EXCLUDED], "o_orderkey long")
    return series.exclude(table(spark, sf_dir, "orders"), "o_orderkey", ids)


def funnel_status(spark, sf_dir):
    return series.funnel_status(_orders(spark, sf_dir), F.col("o_orderstatus"), "F", "O")


def funnel_share(spark, sf_dir):
    return series.shares(funnel_status(spark, sf_dir), ["published", "underReview", "declined"])


def funnel_monthly(spark, sf_dir):
    ym = F.date_format("o_orderdate", "yyyy-MM")
    return _orders(spark, sf_dir).groupBy(ym.alias("ym")).agg(F.count("*").alias("n"))


def _customer_months(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("").alias("label"), F.floor("o_totalprice").cast("string").alias("value"))
    return series.monthly_timeline(rows, ["o_custkey"])


def order_timeline(spark, sf_dir):
    return _customer_months(spark, sf_dir)


def _events(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("value"))


def outer_series(spark, sf_dir):
    return joins.outer_series(_events(spark, sf_dir, "view"), _events(spark, sf_dir, "click"), ["user_id", "day"])


def views_total(spark, sf_dir):
    """View and click counts per user, NULL where a user has none of a kind."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.nullif(F.count_if(F.col("event_type") == "signup"), F.lit(0)).alias("a"), F.nullif(F.count_if(F.col("event_type") == "error"), F.lit(0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("user_id", series.views_total(a, b).alias("total"), series.views_breakdown(a, b, "signups", "errors").alias("breakdown"))


def min_month_series(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min(F.date_format("o_orderdate", "yyyy-MM")).alias("start_ym"))
    return series.from_month(_customer_months(spark, sf_dir), starts, "o_custkey")


def month_ranges(spark, sf_dir):
    span = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return dates.month_ranges(span, F.col("a"), F.col("b"))


def hits_rollup(spark, sf_dir):
    """Purchases per user and day; users without any have a total of 0."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    hits = _events(spark, sf_dir, "purchase").select("user_id", F.col("day").alias("ym"), F.col("value").alias("count")).where("count > 1")
    rolled = series.hits_rollup(users, hits, "user_id")
    return rolled.select("user_id", "total", F.size("months").cast("long").alias("n_months"), series.series_total(F.col("months")).alias("map_total"))


def coverage(spark, sf_dir):
    return series.coverage(hits_rollup(spark, sf_dir))


def line_points(spark, sf_dir):
    return series.line_points(_customer_months(spark, sf_dir), ["o_custkey"])


def bar_geometry(spark, sf_dir):
    return series.bars(_customer_months(spark, sf_dir), ["o_custkey"])


def peak(spark, sf_dir):
    return _customer_months(spark, sf_dir).groupBy("o_custkey").agg(F.greatest(F.max("value"), F.lit(1)).alias("peak"), F.count("*").alias("months"))


_MONTHS = "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS ym, sum(floor(o_totalprice)::BIGINT)::BIGINT AS value FROM orders GROUP BY ALL"
_ROLL = """u AS (SELECT DISTINCT user_id FROM events),
h AS (SELECT user_id, n FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL) WHERE n > 1),
r AS (SELECT u.user_id, coalesce(sum(n), 0)::BIGINT AS total, count(n) AS n_months, coalesce(sum(n), 0)::BIGINT AS map_total FROM u LEFT JOIN h ON h.user_id = u.user_id GROUP BY ALL)"""
_CHART = f"""t AS ({_MONTHS}),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ym) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, greatest(max(value) OVER (PARTITION BY o_custkey), 1) AS peak FROM t)"""

QUERIES = {f.__name__: f for f in (funnel_status, funnel_share, funnel_monthly, order_timeline, outer_series, views_total, min_month_series, month_ranges, hits_rollup, coverage, line_points, bar_geometry, peak)}
_FUNNEL = f"SELECT count(*) FILTER (o_orderstatus = 'F') AS published, count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS \"underReview\", count(*) FILTER (o_orderstatus = 'O') AS declined, count(*) AS total FROM orders WHERE {_NOT}"
SQL = {
    "funnel_status": _FUNNEL,
    "funnel_share": f"""WITH f AS ({_FUNNEL}), r AS (SELECT 0 AS ord, 'published' AS bucket, published AS n FROM f UNION ALL SELECT 1, 'underReview', "underReview" FROM f UNION ALL SELECT 2, 'declined', declined FROM f)
SELECT ord, bucket, n, 100.0::DOUBLE * n / sum(n) OVER () AS pct FROM r WHERE n > 0""",
    "funnel_monthly": f"SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders WHERE {_NOT} GROUP BY ALL",
    "order_timeline": _MONTHS,
    "outer_series": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL",
    "views_total": """WITH e AS (SELECT user_id, nullif(count(*) FILTER (event_type = 'signup'), 0) AS a, nullif(count(*) FILTER (event_type = 'error'), 0) AS b FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS total, concat_ws(' · ', a::VARCHAR || ' signups', b::VARCHAR || ' errors') AS breakdown FROM e""",
    "min_month_series": f"""WITH t AS ({_MONTHS}), s AS (SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m')) AS start_ym FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT t.* FROM t LEFT JOIN s ON s.o_custkey = t.o_custkey WHERE start_ym IS NULL OR ym >= start_ym""",
    "month_ranges": """SELECT m::DATE AS month_start, (m + INTERVAL 1 MONTH)::DATE AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)""",
    "hits_rollup": f"WITH {_ROLL} SELECT * FROM r",
    "coverage": f"WITH {_ROLL} SELECT count(*) FILTER (total > 0) AS covered, count(*) AS keys FROM r",
    "line_points": f"WITH {_CHART} SELECT o_custkey, ym, value, 34.0::DOUBLE + i * (216.0::DOUBLE / (n - 1)) AS x, 4.0::DOUBLE + 74.0::DOUBLE * (1.0::DOUBLE - value::DOUBLE / peak) AS y FROM c WHERE n >= 2",
    "bar_geometry": f"""WITH {_CHART}, g AS (SELECT *, 250.0::DOUBLE / n AS grp, greatest(3.0::DOUBLE, least(16.0::DOUBLE, 250.0::DOUBLE / n - 3.0::DOUBLE)) AS w, 76.0::DOUBLE * value / peak AS tall FROM c WHERE n >= 2)
SELECT o_custkey, ym, value, 30.0::DOUBLE + i * grp + (grp - w) / 2 AS x, 76.0::DOUBLE - tall AS y, w, greatest(tall, 0.5::DOUBLE) AS h FROM g""",
    "peak": f"WITH t AS ({_MONTHS}) SELECT o_custkey, greatest(max(value), 1) AS peak, count(*) AS months FROM t GROUP BY ALL",
}
