"""Metric analytics: reset-aware increases, rates, histogram quantiles, benchmark rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def increases(samples: DataFrame) -> DataFrame:
    """Each counter sample's gain on the one before it in its series; a drop is a restart from 0."""
    before = F.lag("value").over(W.partitionBy("series").orderBy("ts", "id"))
    gain = F.col("value") - before
    return samples.withColumn("gain", F.when(before.isNull(), 0.0).when(gain < 0, F.col("value")).otherwise(gain))


def rates(samples: DataFrame, key: str, width: str, seconds: int) -> DataFrame:
    """Gain per second by tumbling window and key."""
    rows = increases(samples).groupBy(F.window("ts", width).alias("w"), key).agg((F.sum("gain") / seconds).alias("rate"))
    return rows.select(F.col("w.start").alias("start"), key, "rate")


def histogram_quantile(buckets: DataFrame, q: float, by: str) -> DataFrame:
    """Quantile of cumulative buckets (le, cum): linear inside a bucket; the last finite bound beyond; NaN without counts."""
    order = W.partitionBy(by).orderBy("le")
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("cum").over(order), F.lit(0)))
    rows = rows.withColumn("total", F.max("cum").over(W.partitionBy(by)))
    hit = F.min(F.when(F.col("cum") >= q * F.col("total"), F.struct("le", "low", "cum", "before"))).alias("hit")
    out = rows.groupBy(by).agg(hit, F.max("total").alias("total"))
    inside = F.col("hit.low") + (F.col("hit.le") - F.col("hit.low")) * (q * F.col("total") - F.col("hit.before")) / F.nullif(F.col("hit.cum") - F.col("hit.before"), F.lit(0))
    value = F.when(F.col("total") == 0, F.lit(float("nan"))).when(F.col("hit.le") == float("inf"), F.col("hit.low")).otherwise(inside)
    return out.select(by, value.alias("quantile"))


def rollup(runs: DataFrame, by: str, value: Column) -> DataFrame:
    """Mean and interpolated percentiles, rounded to three places."""
    out = runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return out.select(by, "n", F.round("mean", 3).alias("mean"), *[F.round(F.col("p")[k], 3).alias(f"p{name}") for k, name in enumerate((50, 95, 99))])


def dominant_format(records: DataFrame, first: int = 32) -> DataFrame:
    """A batch's format: the class of a strict majority of its first records, else raw."""
    rank = F.row_number().over(W.partitionBy("batch_id").orderBy("position"))
    rows = records.withColumn("rank", rank).where(F.col("rank") <= first)
    votes = rows.groupBy("batch_id", "format").agg(F.count(F.lit(1)).alias("votes"))
    totals = votes.groupBy("batch_id").agg(F.sum("votes").alias("total"), F.max(F.when(F.col("format") != "raw", F.struct("votes", "format"))).alias("best"))
    return totals.select("batch_id", F.when(2 * F.col("best.votes") > F.col("total"), F.col("best.format")).otherwise("raw").alias("format"))
