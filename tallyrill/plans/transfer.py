"""Queries of batches in transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.functions import digests as D
from tallyrill.functions import templates as P
from tallyrill.operators import log as G
from tallyrill.operators import metrics as M
from tallyrill.operators import transfer as T

from .registry import query


@query("records", sql="""WITH p AS (SELECT unit, bytes, (row_number() OVER (PARTITION BY unit ORDER BY position) - 1) // 100 AS batch FROM records)
SELECT unit, batch, count(*) AS records, sum(bytes)::BIGINT AS bytes, (sum(bytes) + count(*))::BIGINT AS framed FROM p GROUP BY unit, batch""")
def batch_by_count(records):
    return T.count_batches(records, 100)


@query("ledger", sql="""SELECT batch_id, CASE WHEN batch_id % 700 >= 600 THEN 'max_records' WHEN bytes >= 100000 THEN 'max_bytes' WHEN batch_id % 61 >= 30 THEN 'max_age' END AS reason FROM ledger""")
def seal_reasons(ledger):
    return ledger.select("batch_id", T.seal_reason(F.col("batch_id") % 700, F.col("bytes"), F.col("batch_id") % 61 + 0.5, 600, 100_000, 30).alias("reason"))


@query("records", sql="""WITH RECURSIVE reads AS (SELECT unit, position // 20 AS position, count(*) AS records, sum(bytes)::BIGINT AS bytes FROM records GROUP BY unit, position // 20),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY position) AS n FROM reads),
  fold AS (SELECT unit, position, records, bytes, n, 0 AS batch, records AS c, bytes AS total FROM ordered WHERE n = 1
    UNION ALL SELECT o.unit, o.position, o.records, o.bytes, o.n, CASE WHEN f.c >= 15 OR f.total >= 200 THEN f.batch + 1 ELSE f.batch END,
      CASE WHEN f.c >= 15 OR f.total >= 200 THEN o.records ELSE f.c + o.records END, CASE WHEN f.c >= 15 OR f.total >= 200 THEN o.bytes ELSE f.total + o.bytes END
    FROM fold f JOIN ordered o ON o.unit = f.unit AND o.n = f.n + 1)
SELECT unit, position, records, bytes, batch::BIGINT AS batch, max((c >= 15 OR total >= 200)::INTEGER) OVER (PARTITION BY unit, batch) = 1 AS sealed FROM fold""")
def read_accumulation(records):
    reads = records.groupBy("unit", F.expr("position div 20").alias("position")).agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))
    return T.accumulated_batches(reads, 15, 200)


@query("ledger", sql="""SELECT batch_id, CASE WHEN batch_id % 5 = 0 THEN CASE WHEN batch_id % 3 = 0 THEN 'failed' ELSE 'limited' END
  WHEN batch_id % 7 = 0 THEN 'failed' WHEN batch_id % 3 = 0 OR batch_id % 11 = 0 THEN 'failed' ELSE 'passed' END AS verdict FROM ledger""")
def content_verification(ledger):
    b = F.col("batch_id")
    algorithm = F.when(b % 5 != 0, F.when(b % 7 == 0, "none").otherwise("SHA256"))
    stored = F.when(b % 3 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))
    return ledger.select("batch_id", T.verify_content(F.col("bytes"), stored, algorithm, F.lit("AB"), F.when(b % 11 == 0, "cd").otherwise("ab")).alias("verdict"))


@query("ledger", sql="""SELECT batch_id, k + 1 AS part, k * 65536 AS start, least(65536, bytes - k * 65536) AS length
FROM (SELECT batch_id, bytes, unnest(range(0, ((bytes + 65535) // 65536)::BIGINT)) AS k FROM ledger WHERE bytes > 0)""")
def multipart_plan(ledger):
    return T.multipart_plan(ledger, 65_536)


_STEPS = ", ".join(f"({k + 2}, '{a}', '{b}')" for k, (a, b) in enumerate(zip(T.STAGES, T.STAGES[1:])))


@query("ledger", sql=f"""SELECT l.batch_id, s.old, s.new, CASE s.new WHEN 'compressed' THEN l.bytes ELSE 0 END AS ms FROM ledger l
JOIN (VALUES {_STEPS}) s(rank, old, new) ON s.rank <= CASE l.state WHEN 'sealed' THEN 2 WHEN 'verified' THEN 7 WHEN 'source_committed' THEN 8 ELSE 0 END
UNION ALL SELECT batch_id, 'batching', 'failed', 0 FROM ledger WHERE state = 'failed'""")
def state_ladder(ledger):
    return T.state_ladder(ledger, {"compressed": "bytes"})


@query("ledger", sql="""SELECT tenant, count(*) AS batches, count(*) FILTER (state = 'failed') AS failed, coalesce(sum(bytes) FILTER (state = 'source_committed'), 0)::BIGINT AS bytes FROM ledger GROUP BY tenant""")
def committed_volume(ledger):
    return T.committed_volume(ledger, "tenant")


@query("ledger", sql="""SELECT batch_id AS run, CASE WHEN h = '' THEN 'none' ELSE h END AS hints FROM (SELECT batch_id, concat_ws(',', CASE WHEN state = 'failed' THEN 'failures' END,
  CASE WHEN batch_id % 30 BETWEEN 1 AND 11 THEN 'low_ratio' END, CASE WHEN batch_id % 101 > 90 THEN 'cpu' END, CASE WHEN batch_id % 9 > 3 AND batch_id % 2 = 1 THEN 'tail_latency' END) AS h FROM ledger)""")
def run_hints(ledger):
    b = F.col("batch_id")
    return T.bottlenecks(ledger.select(b.alias("run"), (F.col("state") == "failed").cast("int").alias("failed_batches"), ((b % 30) / 10.0).alias("ratio"), (b % 101).alias("cpu_max"), (b % 9).cast("double").alias("p99_ms"), (b % 2).cast("double").alias("mean_ms")))


@query("nation", sql="""SELECT a.format, b.codec, c.size, d.batch FROM (VALUES ('jsonl'), ('cef'), ('mixed'), ('binary')) a(format), (VALUES ('gzip1'), ('gzip6'), ('gzip9'), ('zstd1'), ('zstd3'), ('zstd9'), ('none')) b(codec),
  (VALUES ('small'), ('medium')) c(size), (VALUES (1000), (10000)) d(batch) WHERE (SELECT count(*) FROM nation) > 0""")
def sweep_grid(nation):
    axis = lambda name, *values: nation.limit(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    return T.sweep_grid(axis("format", "jsonl", "cef", "mixed", "binary"), axis("codec", "gzip1", "gzip6", "gzip9", "zstd1", "zstd3", "zstd9", "none"), axis("size", "small", "medium"), axis("batch", 1000, 10000))


@query("records", sql="""WITH s AS (SELECT topic, sum(bytes) FILTER (position % 10 <> 0 AND bytes % 4 > 0)::BIGINT AS productive, sum(bytes) FILTER (position % 10 <> 0 AND bytes % 4 = 0)::BIGINT AS empty, sum(bytes) FILTER (position % 10 = 0)::BIGINT AS failed FROM records GROUP BY topic)
SELECT topic, coalesce(productive, 0) AS productive, coalesce(empty, 0) AS empty, coalesce(failed, 0) AS failed,
  CASE WHEN coalesce(productive, 0) + coalesce(empty, 0) + coalesce(failed, 0) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * coalesce(empty, 0) / (coalesce(productive, 0) + coalesce(empty, 0) + coalesce(failed, 0)) END AS idle_pct FROM s""")
def read_profile(records):
    return T.read_profile(records.select("topic", F.col("bytes").alias("ms"), (F.col("bytes") % 4).alias("records"), (F.col("position") % 10 == 0).alias("failed")), "topic")


@query("records", sql="SELECT topic, max(bytes) AS largest, max(bytes) > 8 AS failed FROM records GROUP BY topic")
def oversized_topics(records):
    return T.oversized_topics(records, 8)


@query("records", "marks", sql="""WITH o AS (SELECT range_id, bytes, row_number() OVER (PARTITION BY range_id ORDER BY position) - 1 AS "offset" FROM records)
SELECT o.range_id, coalesce(sum(o.bytes) FILTER (o."offset" < m.high_watermark), 0)::BIGINT AS kept, coalesce(sum(o.bytes) FILTER (NOT coalesce(o."offset" < m.high_watermark, false)), 0)::BIGINT AS cut
FROM o LEFT JOIN (SELECT * FROM marks WHERE range_id % 4 > 0) m ON o.range_id = m.range_id GROUP BY o.range_id""")
def recovery_truncation(records, marks):
    return T.recover_log(G.assign_offsets(records, F.lit(0)).select("range_id", "bytes", "offset"), marks.where("range_id % 4 > 0").select("range_id", F.col("high_watermark").alias("end")))


@query("orders", sql="""SELECT o_orderkey, 'tenant=' || (o_custkey % 7) || '/' || regexp_replace(o_orderpriority, '[^A-Za-z0-9._=-]', '_', 'g') || '/' || strftime(o_orderdate, '%Y/%m/%d/%H') AS path FROM orders""")
def object_keys(orders):
    values = {"tenant": (F.col("o_custkey") % 7).cast("string"), "priority": F.col("o_orderpriority")}
    return orders.select("o_orderkey", P.resolve_template("/tenant={tenant}//{priority}/{unknown}/{yyyy}/{mm}/{dd}/{hh}/", values, F.col("o_orderdate")).alias("path"))


@query("ledger", sql="""SELECT batch_id, 'b' || tenant AS bucket, CASE WHEN batch_id % 4 = 0 THEN NULL ELSE source_name || '/' || batch_id END AS key FROM ledger""")
def storage_addresses(ledger):
    uri = F.concat(F.lit("s3://b"), "tenant", F.when(F.col("batch_id") % 4 == 0, "").otherwise(F.concat(F.lit("/"), "source_name", F.lit("/"), F.col("batch_id").cast("string"))))
    return ledger.select("batch_id", P.bucket_of(uri).alias("bucket"), P.key_of(uri).alias("key"))


@query("events", sql="""SELECT event_id, coalesce(CAST(json_extract_string(CASE event_id % 3 WHEN 0 THEN replace(props, '"k"', '"end_byte"') WHEN 1 THEN replace(props, '"k"', '"end_offset"') ELSE props END, CASE event_id % 3 WHEN 0 THEN '$.end_byte' ELSE '$.end_offset' END) AS BIGINT), -1) AS position FROM events""")
def progress_positions(events):
    doc = F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit('"k"'), F.lit('"end_byte"'))).when(F.col("event_id") % 3 == 1, F.replace("props", F.lit('"k"'), F.lit('"end_offset"'))).otherwise(F.col("props"))
    return events.select("event_id", P.end_position(doc).alias("position"))


@query("events", sql="SELECT event_id, sha256(props) AS digest FROM events")
def object_checksums(events):
    return events.select("event_id", D.content_digest(F.col("props")).alias("digest"))


@query("pages")
def chunk_tree_roots(pages):
    return pages.select("page_id", D.chunk_tree(1024)(F.coalesce("html", F.lit("")).cast("binary")).alias("root"))


_GAIN = "CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END"


@query("samples", sql=f"""WITH g AS (SELECT series, {_GAIN} AS gain FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts, id)), s AS (SELECT series, sum(gain) AS total FROM g GROUP BY series)
SELECT coalesce(sum(total) FILTER (series = 'click'), 0) - coalesce(sum(total) FILTER (series = 'purchase'), 0) AS margin FROM s""")
def invariant_margin(samples):
    total = lambda name: F.coalesce(F.sum(F.when(F.col("series") == name, F.col("gain"))), F.lit(0.0))
    return M.increases(samples).agg((total("click") - total("purchase")).alias("margin"))


@query("ledger", sql="SELECT state, batch_id % 24 AS hour, count(*) / 3600.0::DOUBLE AS rate FROM ledger GROUP BY state, batch_id % 24")
def state_funnel(ledger):
    return ledger.groupBy("state", (F.col("batch_id") % 24).alias("hour")).agg((F.count(F.lit(1)) / 3600.0).alias("rate"))
