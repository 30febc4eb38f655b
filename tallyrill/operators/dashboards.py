"""Dashboard queries: rates, totals and gauges of a transfer, its logs and its cluster.

Counters are reset-aware and not extrapolated to window edges; a gain belongs to the
window of its later sample.  Null keys form a group of their own; a gauge of -1 means
unknown and is left out; empty tables give no groups, and totals of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .metrics import histogram_quantile


def gains(samples: DataFrame, *labels: str) -> DataFrame:
    """``samples`` (series, labels, ts, id, value) with the gain of each on the one before it in its series and labels."""
    before = F.lag("value").over(W.partitionBy("series", *labels).orderBy("ts", "id"))
    step = F.col("value") - before
    return samples.withColumn("gain", F.when(before.isNull(), 0.0).when(step < 0, F.col("value")).otherwise(step))


def _total(name: str, when: Column | None = None) -> Column:
    """The summed gain of a series, 0 without samples."""
    mine = F.col("series") == name
    return F.coalesce(F.sum(F.when(mine if when is None else mine & when, F.col("gain"))), F.lit(0.0))


def recent_increase(samples: DataFrame, names: list[str], window: str, *labels: str) -> DataFrame:
    """One row: how much each named counter grew in the ``window`` that ends with the newest sample; 0 by default."""
    end = samples.agg(F.max("ts").alias("end"))  # one row
    rows = gains(samples, *labels).join(F.broadcast(end))
    recent = F.col("ts") > F.col("end") - F.expr(f"INTERVAL {window}")
    return rows.agg(*[_total(n, recent).alias(n) for n in names])


def rate_by(samples: DataFrame, width: str, seconds: int, by: list[str], *labels: str, series: str | None = None) -> DataFrame:
    """Gain a second by tumbling window and the columns ``by``."""
    rows = gains(samples, *labels)
    rows = rows if series is None else rows.where(F.col("series") == series)
    out = rows.groupBy(F.window("ts", width).alias("w"), *by).agg((F.sum("gain") / seconds).alias("rate"))
    return out.select(F.col("w.start").alias("start"), *by, "rate")


def paired_rates(samples: DataFrame, width: str, seconds: int, names: dict[str, str], *labels: str) -> DataFrame:
    """The rates of several series side by side, as columns: ``names`` from column to series."""
    rows = gains(samples, *labels).groupBy(F.window("ts", width).alias("w")).agg(*[(_total(s) / seconds).alias(c) for c, s in names.items()])
    return rows.select(F.col("w.start").alias("start"), *names)


def totals(samples: DataFrame, names: dict[str, str], *labels: str) -> DataFrame:
    """One row: the summed gain of each named series."""
    return gains(samples, *labels).agg(*[_total(s).alias(c) for c, s in names.items()])


def log_search(logs: DataFrame, levels: str = "WARN|ERROR") -> DataFrame:
    """Log lines (id, line) that are JSON with a level among ``levels``: id, level, message.  Lines that are not JSON are left out."""
    level = F.get_json_object("line", "$.level")
    return logs.where(level.rlike(f"^({levels})$")).select("id", level.alias("level"), F.get_json_object("line", "$.message").alias("message"))


def produced_and_archived(offsets: DataFrame) -> DataFrame:
    """By topic, from samples of its end offsets (topic, partition, at, latest, archived): messages produced and archived since the first."""
    ends = offsets.groupBy("topic", "partition").agg(*[F.expr(f"max_by({c}, at) - min_by({c}, at)").alias(c) for c in ("latest", "archived")])
    return ends.groupBy("topic").agg(F.count(F.lit(1)).alias("partitions"), F.sum("latest").alias("produced"), F.sum("archived").alias("archived"))


def raft_progress(nodes: DataFrame) -> DataFrame:
    """By shard: the farthest log and commit, and the lag of the slowest node with a known commit."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    out = nodes.groupBy("shard").agg(F.max(known("last_log")).alias("last_log"), F.max(known("committed")).alias("committed"), F.min(known("committed")).alias("slowest"))
    return out.select("shard", "last_log", "committed", (F.col("committed") - F.col("slowest")).alias("lag"))


def membership(nodes: DataFrame) -> DataFrame:
    """By shard: running nodes, voters and learners (role 1 and 0), fenced holders, and nodes that no follower is connected to."""
    return nodes.groupBy("shard").agg(F.count_if("running").alias("running"), F.count_if(F.col("role") == 1).alias("voters"), F.count_if(F.col("role") == 0).alias("learners"), F.count_if("fenced").alias("fenced"), F.count_if(F.col("followers") == 0).alias("disconnected"))


def guarded_quantile(buckets: DataFrame, q: float, by: str) -> DataFrame:
    """``histogram_quantile``, 0 where nothing was counted."""
    out = histogram_quantile(buckets, q, by)
    return out.select(by, F.when(F.isnan("quantile"), F.lit(0.0)).otherwise(F.col("quantile")).alias("quantile"))


def memory_by_scope(ledger: DataFrame) -> DataFrame:
    """By scope and shard: bytes held, and refusals by reason as a share of requests (scope, shard, bytes, reason or null)."""
    out = ledger.groupBy("scope").agg(F.sum(F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(0)).alias("held"), F.count("reason").alias("refused"), F.count(F.lit(1)).alias("requests"))
    return out.select("scope", "held", "refused", "requests", (F.col("refused") / F.col("requests")).alias("share"))


def system_rollup(samples: DataFrame, by: str) -> DataFrame:
    """Benchmark system samples (cpu, memory, disk, network): means and peaks of the first two, peaks of the others, two places."""
    wanted = [f(c).alias(f"{n}_{c}") for c in ("cpu", "memory") for n, f in (("avg", F.avg), ("max", F.max))] + [F.max(c).alias(f"max_{c}") for c in ("disk", "network")]
    out = samples.groupBy(by).agg(*wanted)
    return out.select(by, *[F.round(c, 2).alias(c) for c in out.columns if c != by])


def run_rollup(batches: DataFrame, by: str) -> DataFrame:
    """Benchmark batches (files, bytes, packed, ms, ok): counts, throughput, ratio and interpolated latencies of a run.

    Failed batches add no bytes; all divisions are guarded; three places.
    """
    done = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0))
    out = batches.groupBy(by).agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(~F.col("ok")).alias("failed"), done("files").alias("files"), done("bytes").alias("bytes"), done("packed").alias("packed"),
        F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"),
    )
    seconds = F.col("total_ms") / 1000.0
    speed = lambda x: F.round(F.when(F.col("total_ms") > 0, x / seconds).otherwise(F.lit(0.0)), 3)
    return out.select(
        by, "batches", "failed", "files", "bytes", speed(F.col("files")).alias("files_per_sec"), speed(F.col("bytes") / 1048576.0).alias("mib_per_sec"),
        F.round(F.when(F.col("packed") > 0, F.col("bytes") / F.col("packed")).otherwise(F.lit(1.0)), 3).alias("ratio"),
        F.round("mean_ms", 3).alias("mean_ms"), *[F.round(F.col("p")[k], 3).alias(f"p{n}_ms") for k, n in enumerate((50, 95, 99))],
    )


def comparison(runs: DataFrame, baseline: str) -> DataFrame:
    """Each scenario's rollup beside that of the ``baseline`` scenario: speed and latency as multiples of it, and its rank by speed."""
    base = F.broadcast(runs.where(F.col("scenario") == baseline).select(F.col("mib_per_sec").alias("b_speed"), F.col("p95_ms").alias("b_p95")).limit(1))
    rows = runs.join(base, how="left")
    times = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 3)
    rank = F.row_number().over(W.orderBy(F.col("mib_per_sec").desc(), "scenario"))  # as many rows as scenarios
    return rows.select("scenario", "batches", "mib_per_sec", "p95_ms", times("mib_per_sec", "b_speed").alias("speedup"), times("p95_ms", "b_p95").alias("p95_times"), rank.alias("place"))
