"""Mixing sources to target weights by Poisson replication, in DataFrame functions.

A source's mean repetition rate is its target share of the bytes over the bytes it has. Each document gets a uniform
number from a hash of the seed and its id; inverting the Poisson distribution of the source's rate at that number
gives how often the document appears. Copies are exploded and all rows shuffled globally by a second hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillspark.llm._spark import stored, table

#: Exponent of a source's bytes in its weight where no weights are given: below 1, small sources are raised.
TEMPERATURE = 0.7
SEED = 11
#: Sources up to which the table of rates may be broadcast; each row holds about as many doubles as 10 + 12 sqrt(rate).
BROADCAST_SOURCES = 1000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; any SQL engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), .. until no number of 52 bits can lie above."""
    if not rate > 0:
        return []
    out, k, total, log_rate = [], 0, 0.0, math.log(rate)
    while True:
        total += math.exp(-rate + k * log_rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if k > rate and 1.0 - total < 2.0**-53 or k > rate + 60 * math.sqrt(rate) + 200:
            return out
        k += 1


@F.pandas_udf(ArrayType(DoubleType()))
def _steps(rate: pd.Series) -> pd.Series:
    return rate.map(lambda r: np.array(poisson_steps(r)))


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per source: source, n_docs, n_bytes, weight (sum 1), rate.

    epochs is the size of the mixture in bytes over that of the input. A null source is a source of its own. With
    `weights`, sources that it does not name get weight 0. A source whose texts are all empty or null has rate
    `epochs`, since no rate can give it bytes.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(docs[source].alias("source")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length(docs[text])), F.lit(0)).alias("n_bytes"))
    if weights is None:
        raw = sizes.withColumn("raw", F.pow(F.col("n_bytes").cast("double"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, raw double")
        raw = sizes.join(given, "source", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    raw = stored(raw, "source-sizes")
    total = raw.agg(F.coalesce(F.sum("raw"), F.lit(0.0)).alias("raw"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes")).first()
    share = F.col("raw") / F.lit(total["raw"]) if total["raw"] > 0 else F.lit(0.0)
    rate = F.when(F.col("n_bytes") > 0, F.lit(float(epochs)) * share * F.lit(total["n_bytes"]) / F.col("n_bytes")).otherwise(F.lit(float(epochs)))
    return raw.select("source", "n_docs", "n_bytes", share.alias("weight"), rate.alias("rate"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED, marks: bool = True) -> DataFrame:
    """The mixture: all columns of the input, then mix_copy (0, 1, ..) and mix_key, rows in ascending mix_key.

    A document with count 0 does not appear. Rows that repeat an id get equal counts. Null texts have no bytes, but
    are drawn at their source's rate. Columns of the input named mix_copy or mix_key are replaced; without `marks` those
    of the input stay and none is added. Other columns stay as they are, whatever their names. An empty input gives no
    rows.
    """
    rates = source_rates(docs, source, text, weights, epochs, temperature)
    size = rates.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes")).first()
    rates = rates.select(F.col("source").alias("mix_source"), _steps("rate").alias("mix_steps"))
    rates = F.broadcast(rates) if size["n"] <= BROADCAST_SOURCES else rates
    # columns travel under plain names, so that none can clash
    names = [c for c in docs.columns if not (marks and c in ("mix_copy", "mix_key"))]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    held = plain.join(rates, at[source].eqNullSafe(F.col("mix_source")))
    u = uniform(seed, at[doc_id])
    # P(X <= k - 1) <= u < P(X <= k): as many steps lie at or below u as the document has copies
    times = F.size(F.filter("mix_steps", lambda p: p <= u))
    copies = held.withColumn("mix_times", times).where("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1)))
    copies = copies.select(*[at[c] for c in names], "mix_copy", uniform(seed + 1, at[doc_id], F.col("mix_copy")).alias("mix_key"))
    # the key is uniform, so its leading part is the number of its range: no sampling pass
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size["n_bytes"] * epochs) >> 27)
    out = copies.repartitionById(n, F.floor(F.col("mix_key") * n).cast("int")).sortWithinPartitions("mix_key")
    return out.toDF(*names, "mix_copy", "mix_key") if marks else out.drop("mix_copy", "mix_key").toDF(*names)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH s AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0)) AS n_bytes FROM documents GROUP BY source),
r AS (SELECT source, pow(n_bytes::DOUBLE, {TEMPERATURE}) / sum(pow(n_bytes::DOUBLE, {TEMPERATURE})) OVER () * sum(n_bytes) OVER () / n_bytes AS rate FROM s),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM r, (SELECT unnest(range(0, 200)) AS k)),
u AS (SELECT *, ('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
n AS (SELECT u.doc_id, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars, count(*) AS times
  FROM u JOIN steps ON steps.source = u.source AND steps.p <= u.u GROUP BY u.doc_id),
c AS (SELECT *, unnest(range(0, times))::INTEGER AS mix_copy FROM n)
SELECT doc_id, text, lang, source, n_chars, mix_copy, ('0x' || substr(md5('{SEED + 1}|' || doc_id || '|' || mix_copy), 1, 13))::BIGINT / pow(2, 52) AS mix_key FROM c
"""
