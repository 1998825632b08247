"""Order-dependent folds as windows; every input has an explicit ordinal."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _running(keys: list[str], order: str):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def sectionize(df: DataFrame, keys: list[str], order: str, opens: Column) -> DataFrame:
    """Adds `section`, the number of openings so far; rows before the first are dropped."""
    return df.withColumn("section", F.sum(opens.cast("int")).over(_running(keys, order))).where("section > 0")


def section_rows(df: DataFrame, keys: list[str], order: str, opens: Column, title: Column, kind: Column, text: str) -> DataFrame:
    """One row per section: its title, its members (rows of kind 'list') and its note (rows of kind 'text').

    Sections with neither are dropped.
    """
    s = sectionize(df, keys, order, opens).withColumns({"__open": opens, "__title": title, "__kind": kind})
    member, note = F.when(F.col("__kind") == "list", F.struct(order, text)), F.when((F.col("__kind") == "text") & ~F.col("__open"), F.struct(order, text))
    out = s.groupBy(*keys, "section").agg(
        F.max(F.when(F.col("__open"), F.col("__title"))).alias("title"), F.array_sort(F.collect_list(member)).alias("m"), F.array_sort(F.collect_list(note)).alias("n")
    )
    out = out.select(*keys, "section", "title", F.transform("m", lambda x: x[text]).alias("members"), F.array_join(F.transform("n", lambda x: x[text]), "").alias("note"))
    return out.where((F.size("members") > 0) | (F.col("note") != ""))


def unique_slugs(df: DataFrame, keys: list[str], order: str, slug: str) -> DataFrame:
    """Adds `unique_slug`: the slug, or the slug with the first of -2, -3 .. that no earlier row of the key took.

    The rule looks at all slugs used so far, made ones included, so it is a fold over each key's rows in order; rows of
    equal order are taken by slug. An empty slug is `section-<position>`. The rows of many keys pass through one Arrow
    function, sorted, and only the slugs of the key at hand are kept: a key is one document.
    """
    schema = df.withColumn("unique_slug", F.lit("")).schema
    same = lambda a, b: len(a) == len(b) and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def fold(batches):
        at, i, used, upto = (), 0, set(), {}
        for batch in batches:
            out = []
            for *key, base in zip(*(batch.column(c).to_pylist() for c in keys), batch.column(slug).to_pylist(), strict=True):
                if not same(key, at):
                    at, i, used, upto = key, 0, set(), {}
                base = base or f"section-{i}"
                name, n = base, upto.get(base, 2)
                while name in used:
                    name, n = f"{base}-{n}", n + 1
                upto[base] = n
                used.add(name)
                out.append(name)
                i += 1
            made = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"unique_slug": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([made[c] for c in schema.names], names=schema.names)

    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, F.col(order).asc_nulls_last(), slug).mapInArrow(fold, schema)


def simple_unique_slugs(df: DataFrame, keys: list[str], order: str, slug: str) -> DataFrame:
    """The same where no slug equals a made one: a row number within each slug, no Python."""
    n = F.row_number().over(W.partitionBy(*keys, slug).orderBy(order))
    return df.withColumn("unique_slug", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n)))


def start_gate(df: DataFrame, keys: list[str], order: str, start: Column) -> DataFrame:
    """Rows from the first start on; a key without a start keeps all its rows."""
    s = df.withColumn("__s", start.cast("int"))
    s = s.withColumn("__started", F.max("__s").over(_running(keys, order))).withColumn("__any", F.max("__s").over(W.partitionBy(*keys)))
    return s.where("__started = 1 OR coalesce(__any, 0) = 0").drop("__s", "__started", "__any")


def inside_gate(keys: list[str], order: str, heading: Column, inside: Column) -> Column:
    """Whether the last heading so far (this row included) is one of those that open the gate."""
    last = F.last(F.when(heading, inside), ignorenulls=True).over(_running(keys, order))
    return F.coalesce(last, F.lit(False))


def running_number(keys: list[str], order: str, counted: Column) -> Column:
    """1, 2, .. for counted rows, NULL for others."""
    return F.when(counted, F.sum(counted.cast("int")).over(_running(keys, order)))


def group_first_seen(df: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """Groups in the order of their first row, each with its rows in order."""
    g = df.groupBy(group).agg(F.min(order).alias("first_ord"), F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))
    return g.orderBy("first_ord")
