"""Queries of dashboards and benchmark rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.operators import dashboards as D

from .registry import query

_G = """g AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS gain
  FROM counters WINDOW w AS (PARTITION BY series, kind ORDER BY ts, id))"""


@query("counters", sql=f"""WITH {_G}, e AS (SELECT max(ts) AS stop FROM counters)
SELECT coalesce(sum(gain) FILTER (series = 'error' AND ts > stop - INTERVAL 1 HOUR), 0)::DOUBLE AS error, coalesce(sum(gain) FILTER (series = 'replayed' AND ts > stop - INTERVAL 1 HOUR), 0)::DOUBLE AS replayed,
  coalesce(sum(gain) FILTER (series = 'signup' AND ts > stop - INTERVAL 1 HOUR), 0)::DOUBLE AS signup FROM g CROSS JOIN e""")
def failures_last_hour(counters):
    return D.recent_increase(counters, ["error", "replayed", "signup"], "1 HOUR", "kind")


@query("counters", sql=f"WITH {_G} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, series, sum(gain) / 3600 AS rate FROM g GROUP BY 1, 2")
def funnel_rates(counters):
    return D.rate_by(counters, "1 hour", 3600, ["series"], "kind")


@query("counters", sql=f"""WITH {_G} SELECT time_bucket(INTERVAL '1 day', ts) AS start, coalesce(sum(gain) FILTER (series = 'purchase'), 0) / 86400 AS strong, coalesce(sum(gain) FILTER (series = 'click'), 0) / 86400 AS limited FROM g GROUP BY 1""")
def verification_rates(counters):
    return D.paired_rates(counters, "1 day", 86_400, {"strong": "purchase", "limited": "click"}, "kind")


@query("counters", sql=f"WITH {_G} SELECT time_bucket(INTERVAL '1 day', ts) AS start, kind, sum(gain) / 86400 AS rate FROM g WHERE series = 'view' GROUP BY 1, 2")
def records_by_format(counters):
    return D.rate_by(counters, "1 day", 86_400, ["kind"], "kind", series="view")


@query("counters", sql=f"WITH {_G} SELECT coalesce(sum(gain) FILTER (series = 'view'), 0)::DOUBLE AS bytes_in, coalesce(sum(gain) FILTER (series = 'click'), 0)::DOUBLE AS bytes_out FROM g")
def bytes_in_and_out(counters):
    return D.totals(counters, {"bytes_in": "view", "bytes_out": "click"}, "kind")


@query("counters", sql=f"WITH {_G} SELECT time_bucket(INTERVAL '1 day', ts) AS start, kind, sum(gain) / 86400 AS rate FROM g WHERE series = 'error' GROUP BY 1, 2")
def read_errors_by_type(counters):
    return D.rate_by(counters, "1 day", 86_400, ["kind"], "kind", series="error")


@query("counters", sql=f"WITH {_G} SELECT time_bucket(INTERVAL '1 day', ts) AS start, kind, series, sum(gain) / 86400 AS rate FROM g GROUP BY 1, 2, 3")
def requests_by_kind(counters):
    return D.rate_by(counters, "1 day", 86_400, ["kind", "series"], "kind")


@query("counters", sql="""WITH bounds AS (SELECT unnest([50.0, 100.0, 200.0, 300.0, 'inf'::DOUBLE]) AS le), b AS (SELECT kind, le, count(*) FILTER (value <= le AND kind <> 'k3') AS cum FROM counters CROSS JOIN bounds GROUP BY kind, le),
  r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cum) OVER w, 0) AS before, max(cum) OVER (PARTITION BY kind) AS total FROM b WINDOW w AS (PARTITION BY kind ORDER BY le)),
  h AS (SELECT * FROM r WHERE cum >= 0.99::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY kind ORDER BY le) = 1)
SELECT kind, CASE WHEN total = 0 THEN 0.0::DOUBLE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (0.99::DOUBLE * total - before) / (cum - before) END AS quantile FROM h""")
def idle_guarded_p99(counters):
    bounds = F.explode(F.array(*[F.lit(x) for x in (50.0, 100.0, 200.0, 300.0, float("inf"))]))
    buckets = counters.withColumn("le", bounds).groupBy("kind", "le").agg(F.count_if((F.col("value") <= F.col("le")) & (F.col("kind") != "k3")).alias("cum"))
    return D.guarded_quantile(buckets, 0.99, "kind")


@query("events", sql="""WITH l AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"level":"ERROR","message":"' || event_type || '"}' WHEN 1 THEN '{"level":"INFO","message":"x"}' WHEN 2 THEN '{"level":"WARN"}' ELSE 'ERROR ' || event_type END AS line FROM events)
SELECT id, CASE id % 4 WHEN 0 THEN 'ERROR' ELSE 'WARN' END AS level, CASE id % 4 WHEN 0 THEN json_extract_string(line, '$.message') END AS message FROM l WHERE id % 4 IN (0, 2)""")
def log_search(events):
    line = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"level":"ERROR","message":"' || event_type || '"}' WHEN 1 THEN '{"level":"INFO","message":"x"}' WHEN 2 THEN '{"level":"WARN"}' ELSE 'ERROR ' || event_type END""")
    return D.log_search(events.select(F.col("event_id").alias("id"), line.alias("line")))


@query("records", sql="""WITH p AS (SELECT topic, unit, max(position) - min(position) AS produced, arg_max(position // 3 * 2, position) - arg_min(position // 3 * 2, position) AS archived FROM records GROUP BY topic, unit)
SELECT topic, count(*) AS partitions, sum(produced)::BIGINT AS produced, sum(archived)::BIGINT AS archived FROM p GROUP BY topic""")
def produced_and_archived(records):
    return D.produced_and_archived(records.select("topic", F.col("unit").alias("partition"), F.col("position").alias("at"), F.col("position").alias("latest"), F.expr("position div 3 * 2").alias("archived")))


@query("gauges", sql="""SELECT shard, max(last_log) FILTER (last_log >= 0) AS last_log, max(committed) FILTER (committed >= 0) AS committed, max(committed) FILTER (committed >= 0) - min(committed) FILTER (committed >= 0) AS lag FROM gauges GROUP BY shard""")
def raft_progress(gauges):
    return D.raft_progress(gauges)


@query("gauges", sql="""SELECT shard, count(*) FILTER (running) AS running, count(*) FILTER (role = 1) AS voters, count(*) FILTER (role = 0) AS learners, count(*) FILTER (fenced) AS fenced, count(*) FILTER (followers = 0) AS disconnected FROM gauges GROUP BY shard""")
def shard_membership(gauges):
    return D.membership(gauges)


@query("records", sql="""SELECT topic AS scope, coalesce(sum(bytes) FILTER (position % 8 > 0), 0)::BIGINT AS held, count(*) FILTER (position % 8 = 0) AS refused, count(*) AS requests, count(*) FILTER (position % 8 = 0) / count(*)::DOUBLE AS share FROM records GROUP BY topic""")
def memory_by_scope(records):
    return D.memory_by_scope(records.select(F.col("topic").alias("scope"), "bytes", F.when(F.col("position") % 8 == 0, "process_full").alias("reason")))


@query("lineitem", sql="""SELECT l_returnflag AS run, round(avg(l_quantity), 2) AS avg_cpu, max(l_quantity) AS max_cpu, round(avg(l_tax * 100), 2) AS avg_memory, round(max(l_tax * 100), 2) AS max_memory, round(max(l_extendedprice), 2) AS max_disk, round(max(l_discount * 1000), 2) AS max_network FROM lineitem GROUP BY 1""")
def system_rollup(lineitem):
    return D.system_rollup(lineitem.select(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("cpu"), (F.col("l_tax") * 100).alias("memory"), F.col("l_extendedprice").alias("disk"), (F.col("l_discount") * 1000).alias("network")), "run")


_RUNS = """runs AS (SELECT tenant AS scenario, count(*) AS batches, count(*) FILTER (state = 'failed') AS failed, (count(*) FILTER (state <> 'failed') * 2)::BIGINT AS files, coalesce(sum(bytes) FILTER (state <> 'failed'), 0)::BIGINT AS bytes,
  coalesce(sum(bytes // 3) FILTER (state <> 'failed'), 0) AS packed, sum(batch_id % 97)::DOUBLE AS total_ms, avg(batch_id % 97) AS mean_ms, quantile_cont(batch_id % 97, [0.5, 0.95, 0.99]) AS p FROM ledger GROUP BY tenant),
  rolled AS (SELECT scenario, batches, failed, files, bytes, round(CASE WHEN total_ms > 0 THEN files / (total_ms / 1000.0::DOUBLE) ELSE 0 END, 3) AS files_per_sec, round(CASE WHEN total_ms > 0 THEN bytes / 1048576.0::DOUBLE / (total_ms / 1000.0::DOUBLE) ELSE 0 END, 3) AS mib_per_sec,
  round(CASE WHEN packed > 0 THEN bytes / packed::DOUBLE ELSE 1 END, 3) AS ratio, round(mean_ms, 3) AS mean_ms, round(p[1], 3) AS p50_ms, round(p[2], 3) AS p95_ms, round(p[3], 3) AS p99_ms FROM runs)"""


def _rolled(ledger):
    return D.run_rollup(ledger.select(F.col("tenant").alias("scenario"), F.lit(2).cast("long").alias("files"), "bytes", F.expr("bytes div 3").alias("packed"), (F.col("batch_id") % 97).alias("ms"), (F.col("state") != "failed").alias("ok")), "scenario")


@query("ledger", sql=f"WITH {_RUNS} SELECT * FROM rolled")
def run_rollup(ledger):
    return _rolled(ledger)


@query("ledger", sql=f"""WITH {_RUNS}, b AS (SELECT mib_per_sec AS s, p95_ms AS l FROM rolled WHERE scenario = 't3')
SELECT scenario, batches, mib_per_sec, p95_ms, round(CASE WHEN s > 0 THEN mib_per_sec / s END, 3) AS speedup, round(CASE WHEN l > 0 THEN p95_ms / l END, 3) AS p95_times, row_number() OVER (ORDER BY mib_per_sec DESC, scenario)::INTEGER AS place FROM rolled LEFT JOIN b ON true""")
def scenario_comparison(ledger):
    return D.comparison(_rolled(ledger), "t3")
