"""Queries of a cluster's metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.functions import digests as D
from tallyrill.operators import cluster as C

from .registry import query


def _key(column: str):
    return F.shiftleft(F.col(column) * 2_654_435_761 % 65_536, 48)


@query("orders", sql="""WITH k AS (SELECT o_orderkey AS id, o_orderkey * 2654435761 % 65536 AS high FROM orders)
SELECT id, CASE WHEN high < 32768 THEN 1 WHEN high < 49152 THEN 2 WHEN high < 57344 THEN 3 ELSE 4 END AS range_id FROM k""")
def range_routing(orders):
    ranges = orders.limit(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("range_id"), F.shiftleft(F.lit(p).cast("long"), 48).alias("prefix"), F.lit(b).alias("bits")) for r, p, b in ((1, 0, 1), (2, 32768, 2), (3, 49152, 3), (4, 57344, 3))])).alias("r")).select("r.*")
    return C.route_keys(orders.select(F.col("o_orderkey").alias("id"), _key("o_orderkey").alias("key")), ranges)


@query("nation", sql="""SELECT n_nationkey AS range_id, CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN n_nationkey % 2 = 1 WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS valid FROM nation""")
def lineage_validity(nation):
    n = F.col("n_nationkey")
    half = F.shiftleft(F.lit(1).cast("long"), 63)
    whole, low, high = (F.struct(p.alias("prefix"), F.lit(b).alias("bits"), F.lit(0).alias("generation")) for p, b in ((F.lit(0).cast("long"), 0), (F.lit(0).cast("long"), 1), (half, 1)))
    none = F.filter(F.array(whole), lambda x: F.lit(False))
    parents = F.when(n % 5 == 0, none).when(n % 5 == 1, F.array(whole)).when(n % 5 == 2, F.array(low, high)).when(n % 5 == 3, F.array(low, low)).otherwise(none)
    rows = nation.select(n.alias("range_id"), F.when(n % 5 == 1, half).otherwise(F.lit(0).cast("long")).alias("prefix"), F.when(n % 5 == 1, F.when(n % 2 == 1, 1).otherwise(2)).otherwise(0).alias("bits"), F.when(n % 5 == 0, 0).otherwise(1).alias("generation"), parents.alias("parents"))
    return C.lineage_valid(rows)


@query("replicas", sql="""SELECT segment, count(*) FILTER (NOT leader AND "offset" >= own) AS acks, 1 + count(*) FILTER (NOT leader AND "offset" >= own) >= 2 AS quorum
FROM (SELECT *, max("offset") FILTER (leader) OVER (PARTITION BY segment) AS own FROM replicas) GROUP BY segment""")
def quorum_acks(replicas):
    return C.quorum_acks(replicas)


@query("epochs", sql="""WITH k AS (SELECT *, CASE WHEN range_id % 3 > 0 THEN range_id * 4 END AS cut FROM epochs) SELECT range_id, epoch, start_offset, coalesce(lead(start_offset) OVER (PARTITION BY range_id ORDER BY start_offset), cut) AS stop FROM k WHERE cut IS NULL OR start_offset < cut""")
def epoch_truncation(epochs):
    return C.truncate_epochs(epochs, epochs.where("range_id % 3 > 0").select("range_id", (F.col("range_id") * 4).alias("cut")).distinct())


@query("records", sql="SELECT position, position * 7919 % 613 AS request_id, min(position) OVER w AS original, position > min(position) OVER w AS repeat FROM records WINDOW w AS (PARTITION BY position * 7919 % 613)")
def request_dedup(records):
    return C.first_requests(records.select("position", (F.col("position") * 7919 % 613).alias("request_id")))


@query("customer", "orders", sql="SELECT c_custkey AS member, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING max(o_orderkey) IS NULL OR max(o_orderkey) < 1000")
def stale_members(customer, orders):
    return C.stale_members(customer.select(F.col("c_custkey").alias("member")), orders.select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("at")), F.lit(1000))


@query("records", sql="SELECT position, producer, epoch, coalesce(epoch >= max(epoch) OVER (PARTITION BY producer ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM records")
def epoch_journal(records):
    return C.newest_epochs(records.select("position", "producer", "epoch"))


@query("supplier", "part", sql="""WITH n AS (SELECT s_suppkey AS node, s_nationkey AS domain, s_suppkey % 6 > 0 AS fit FROM supplier), m AS (SELECT p_partkey AS segment, p_partkey % 10 + 1 AS "from", p_partkey % 7 + 1 AS "to" FROM part),
  p AS (SELECT p_partkey AS segment, unnest([p_partkey % 5 + 1, p_partkey % 5 + 2]) AS node FROM part), h AS (SELECT p.segment, p.node, n.domain FROM p LEFT JOIN n ON p.node = n.node)
SELECT m.segment, m."from", m."to", CASE WHEN m."from" = m."to" THEN 'same_node' WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.segment = m.segment AND h.node = m."from") THEN 'source_not_placed'
  WHEN EXISTS (SELECT 1 FROM h WHERE h.segment = m.segment AND h.node = m."to") THEN 'target_placed' WHEN t.fit IS NOT TRUE THEN 'target_unfit'
  WHEN EXISTS (SELECT 1 FROM h WHERE h.segment = m.segment AND h.node <> m."from" AND h.domain = t.domain) THEN 'domain_taken' ELSE 'ok' END AS verdict FROM m LEFT JOIN n t ON m."to" = t.node""")
def rebalance_verdicts(supplier, part):
    k = F.col("p_partkey")
    nodes = supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("domain"), F.when(F.col("s_suppkey") % 6 > 0, "active").otherwise("dead").alias("state"), F.lit(1).alias("weight"))
    moves = part.select(k.alias("segment"), (k % 10 + 1).alias("from"), (k % 7 + 1).alias("to"))
    return C.rebalance_verdicts(moves, part.select(k.alias("segment"), F.explode(F.array(k % 5 + 1, k % 5 + 2)).alias("node")), nodes)


@query("orders", "marks", sql="""SELECT o_orderkey AS segment, CASE WHEN o_orderkey % 9 = 0 THEN 'not_verified' WHEN o_orderkey % 11 = 0 THEN 'rebalancing' WHEN o_orderkey % 13 = 0 THEN 'being_replaced' WHEN o_orderkey % 3 > 0 AND o_orderkey % 7 = 0 THEN 'copy_differs'
  WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'no_copy' WHEN m.high_watermark < o_custkey THEN 'cursor_behind' ELSE 'ok' END AS verdict FROM orders LEFT JOIN marks m ON o_custkey % 30 = m.range_id""")
def retention_verdicts(orders, marks):
    k = F.col("o_orderkey")
    segments = orders.select(k.alias("segment"), (F.col("o_custkey") % 30).alias("range_id"), F.col("o_custkey").alias("next_offset"), F.when(k % 9 == 0, "sealed").otherwise("verified").alias("state"), F.lit("r").alias("root"), (k % 11 == 0).alias("intent"), (k % 13 == 0).alias("proof"), (k % 2 != 0).alias("policy"))
    tiers = orders.where(k % 3 > 0).select(k.alias("segment"), F.when(k % 7 == 0, "x").otherwise("r").alias("root"), F.lit(1).alias("version"))
    return C.retention_verdicts(segments, tiers, marks.select("range_id", F.col("high_watermark").alias("record_offset")))


@query("orders", "records", sql="""WITH e AS (SELECT topic, unit AS "partition", max(position) AS latest, min(position) AS oldest FROM records GROUP BY topic, unit), c AS (SELECT topic, unit AS "partition", max(position) AS committed FROM records WHERE position % 7 = 0 AND unit % 5 > 0 GROUP BY topic, unit)
SELECT e.topic, e."partition", greatest(latest - coalesce(committed, oldest), 0) AS lag, latest - oldest AS retained FROM e LEFT JOIN c ON e.topic = c.topic AND e."partition" = c."partition" """)
def consumer_lag(orders, records):
    by = ["topic", F.col("unit").alias("partition")]
    ends = records.groupBy(*by).agg(F.max("position").alias("latest"), F.min("position").alias("oldest"))
    return C.consumer_lag(ends, records.where("position % 7 = 0 AND unit % 5 > 0").groupBy(*by).agg(F.max("position").alias("committed")))


@query("supplier", sql="""SELECT count(*) FILTER (s_suppkey % 9 > 0)::BIGINT AS running, count(*) FILTER (s_suppkey = 3) = 1 AS one_leader, max(s_suppkey * 13 % 101) AS term, max(s_suppkey % 40 - 1) FILTER (s_suppkey % 40 - 1 >= 0) AS ack_age FROM supplier""")
def cluster_health(supplier):
    k = F.col("s_suppkey")
    return C.cluster_health(supplier.select((k % 9 > 0).cast("int").alias("running"), (k == 3).cast("int").alias("leads"), (k * 13 % 101).alias("term"), (k % 40 - 1).alias("ack_age")))


@query("supplier", sql="""SELECT s_suppkey AS node, (('0x' || substr(sha256('seg|' || s_suppkey), 1, 16))::UBIGINT::DECIMAL(38,0) * (s_suppkey % 4 + 1) % 1000000007)::BIGINT AS score FROM supplier""")
def rendezvous_scores(supplier):
    score = D.rendezvous_score(F.lit("seg"), F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4 + 1)
    return supplier.select(F.col("s_suppkey").alias("node"), (score % F.lit(1_000_000_007)).cast("long").alias("score"))


@query("events", sql="""WITH RECURSIVE c AS (SELECT user_id % 20 AS range_id, event_id AS position, CASE event_id % 5 WHEN 1 THEN 'renew' WHEN 2 THEN 'release' WHEN 4 THEN 'grant' ELSE 'acquire' END AS verb, event_id % 3 AS node, event_id AS at_, event_id % 90 AS duration, event_id % 7 AS claimed,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
  fold AS (SELECT range_id, 0::BIGINT AS n, NULL::BIGINT AS position, '' AS answer, 0::BIGINT AS epoch, NULL::BIGINT AS holder, NULL::BIGINT AS until, false AS live FROM (SELECT DISTINCT range_id FROM c)
    UNION ALL SELECT range_id, n, position, answer, epoch + CASE WHEN answer = 'ok' AND verb IN ('grant', 'acquire') THEN 1 ELSE 0 END, CASE WHEN answer = 'ok' AND verb IN ('grant', 'acquire') THEN node ELSE holder END,
      CASE WHEN answer <> 'ok' THEN until WHEN verb = 'grant' THEN NULL WHEN verb = 'acquire' THEN at_ + duration WHEN verb = 'renew' THEN greatest(until, at_ + duration) ELSE until END,
      CASE WHEN answer <> 'ok' THEN live WHEN verb = 'release' THEN false WHEN verb IN ('grant', 'acquire') THEN true ELSE live END
    FROM (SELECT c.*, f.epoch, f.holder, f.until, f.live, CASE WHEN verb IN ('acquire', 'renew') AND duration <= 0 THEN 'bad_duration' WHEN verb = 'grant' THEN 'ok'
        WHEN verb = 'acquire' THEN CASE WHEN f.live AND f.until IS NULL THEN 'no_deadline' WHEN f.live AND f.holder <> node AND at_ < f.until THEN 'held' ELSE 'ok' END
        WHEN NOT f.live THEN 'no_lease' WHEN f.holder <> node THEN 'not_holder' WHEN claimed <> f.epoch % 7 THEN 'epoch_mismatch' WHEN verb = 'release' THEN 'ok' WHEN f.until IS NULL THEN 'no_deadline' WHEN at_ >= f.until THEN 'expired' ELSE 'ok' END AS answer
      FROM fold f JOIN c ON c.range_id = f.range_id AND c.n = f.n + 1))
SELECT range_id, position, answer, epoch AS fencing_epoch FROM fold WHERE n > 0""")
def lease_fold(events):
    e = F.col("event_id")
    verb = F.element_at(F.array(*map(F.lit, ("acquire", "renew", "release", "acquire", "grant"))), (e % 5 + 1).cast("int"))
    commands = events.select((F.col("user_id") % 20).alias("range_id"), e.alias("position"), verb.alias("verb"), (e % 3).alias("node"), e.alias("at"), (e % 90).alias("duration"), (e % 7).alias("epoch"))
    return C.lease_fold(commands, epochs=7)


@query("records", sql="""WITH RECURSIVE c AS (SELECT epoch AS group_id, range_id, position, position % 4 AS expected, position % 9 AS segment, position % 7 * 500 AS base, position % 7 * 500 + 9000 AS stop,
    row_number() OVER (PARTITION BY epoch, range_id ORDER BY position) AS n FROM records),
  fold AS (SELECT group_id, range_id, 0::BIGINT AS n, NULL::BIGINT AS position, '' AS answer, 0::BIGINT AS generation, NULL::BIGINT AS place, NULL::BIGINT AS own FROM (SELECT DISTINCT group_id, range_id FROM c)
    UNION ALL SELECT group_id, range_id, n, position, answer, generation + (answer = 'ok')::BIGINT, CASE answer WHEN 'ok' THEN position ELSE place END, CASE answer WHEN 'ok' THEN segment ELSE own END
    FROM (SELECT c.*, f.generation, f.place, f.own, CASE WHEN c.position NOT BETWEEN base AND stop THEN 'outside_segment' WHEN expected <> f.generation % 4 THEN 'generation_mismatch' WHEN c.position < f.place OR (segment <> f.own AND c.position = f.place) THEN 'backward' ELSE 'ok' END AS answer
      FROM fold f JOIN c ON c.group_id = f.group_id AND c.range_id = f.range_id AND c.n = f.n + 1))
SELECT group_id, range_id, position, answer, generation FROM fold WHERE n > 0""")
def cursor_fold(records):
    p = F.col("position")
    return C.cursor_fold(records.select(F.col("epoch").alias("group_id"), "range_id", "position", (p % 4).alias("expected"), (p % 9).alias("segment"), (p % 7 * 500).alias("base"), (p % 7 * 500 + 9000).alias("next"), p.alias("offset")), generations=4)


@query("records", sql="""WITH RECURSIVE c AS (SELECT unit AS shard, position, position % 2 = 0 AS produce, CASE WHEN position % 3 = 0 THEN -bytes ELSE bytes * 5 END AS size, row_number() OVER (PARTITION BY unit ORDER BY position) AS n FROM records),
  fold AS (SELECT shard, 0::BIGINT AS n, NULL::BIGINT AS position, NULL::VARCHAR AS refused_by, 0::BIGINT AS con, 0::BIGINT AS own, 0::BIGINT AS queue, 0::BIGINT AS process FROM (SELECT DISTINCT shard FROM c)
    UNION ALL SELECT shard, n, position, why, CASE WHEN why IS NULL THEN greatest(0, con + size) ELSE con END, CASE WHEN why IS NULL AND produce THEN greatest(0, own + size) ELSE own END, CASE WHEN why IS NULL AND NOT produce THEN greatest(0, queue + size) ELSE queue END, CASE WHEN why IS NULL THEN greatest(0, process + size) ELSE process END
    FROM (SELECT c.*, f.con, f.own, f.queue, f.process, CASE WHEN size <= 0 THEN NULL WHEN f.con + size > 300 THEN 'connection' WHEN produce AND f.own + size > 800 THEN 'shard' WHEN NOT produce AND f.queue + size > 500 THEN 'queue' WHEN f.process + size > 1000 THEN 'process' END AS why
      FROM fold f JOIN c ON c.shard = f.shard AND c.n = f.n + 1))
SELECT shard, position, refused_by FROM fold WHERE n > 0""")
def memory_reservations(records):
    scopes = {"produce": [("connection", 300), ("shard", 800), ("process", 1000)], "fetch": [("connection", 300), ("queue", 500), ("process", 1000)]}
    size = F.when(F.col("position") % 3 == 0, -F.col("bytes")).otherwise(F.col("bytes") * 5)
    return C.reservations_fold(records.select(F.col("unit").alias("shard"), "position", F.when(F.col("position") % 2 == 0, "produce").otherwise("fetch").alias("kind"), size.alias("bytes")), scopes)
