"""Queries on append-only logs: budgets, offsets, visibility, epochs, batches, replicas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def admit_by_topic(records: DataFrame, most: int, max_bytes: int) -> DataFrame:
    """The records of each topic before its count or byte budget is first exceeded."""
    upto = W.partitionBy("topic").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = records.withColumn("n", F.row_number().over(W.partitionBy("topic").orderBy("position"))).withColumn("total", F.sum("bytes").over(upto))
    breaks = (F.col("n") > most) | (F.col("total") > max_bytes) | (F.col("total") - F.col("bytes") >= max_bytes)
    return rows.withColumn("broken", F.max(breaks.cast("int")).over(upto)).where("broken = 0").select("topic", "position", "bytes")


def assign_offsets(records: DataFrame, base: Column) -> DataFrame:
    """Dense offsets by range in arrival order."""
    return records.withColumn("offset", base + F.row_number().over(W.partitionBy("range_id").orderBy("position")) - 1)


def visible(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Records under their range's visible end: the lesser of high watermark and committed end."""
    ends = marks.select("range_id", F.least("high_watermark", "committed").alias("end"))
    return records.join(ends, "range_id").where("offset < end").drop("end")


def fetch(records: DataFrame, start: int, most: int, max_bytes: int) -> DataFrame:
    """Per range, records from an offset within both budgets; the first one always.

    Offsets are dense, so records beyond ``start + most`` are left out before any sorting.
    """
    upto = W.partitionBy("range_id").orderBy("offset")
    near = records.where((F.col("offset") >= start) & (F.col("offset") < start + max(most, 1)))
    rows = near.withColumn("n", F.row_number().over(upto)).withColumn("total", F.sum("bytes").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where((F.col("n") == 1) | ((F.col("n") <= most) & (F.col("total") <= max_bytes))).select("range_id", "offset", "bytes")


def fetch_through(records: DataFrame, segments: DataFrame, marks: DataFrame, start: int, most: int, max_bytes: int) -> DataFrame:
    """Per range, a fetch across its segments up to the visible end: records, bytes, next_offset, segments touched.

    records: range_id, offset, bytes; segments: range_id, base, next (half-open, not
    overlapping); marks: range_id, high_watermark, committed.  A fetch ends at the first
    offset that no segment holds; one that returns nothing has next_offset = start.
    """
    ends = marks.select("range_id", F.least("high_watermark", "committed").alias("end"))
    seen = records.join(ends, "range_id").where("offset < end").drop("end")
    got = fetch(seen, start, most, max_bytes).withColumn("place", F.row_number().over(W.partitionBy("range_id").orderBy("offset")))
    dense = got.where(F.col("offset") - F.col("place") + 1 == start)  # up to the first missing offset
    s = segments.alias("s")
    held = dense.alias("g").join(s, (F.col("g.range_id") == F.col("s.range_id")) & (F.col("g.offset") >= F.col("s.base")) & (F.col("g.offset") < F.col("s.next")), "left").select("g.*", F.col("s.base").alias("base"))
    hole = F.min(F.when(F.col("base").isNull(), F.col("offset"))).over(W.partitionBy("range_id"))
    held = held.withColumn("hole", hole).where(F.col("hole").isNull() | (F.col("offset") < F.col("hole")))
    sums = held.groupBy("range_id").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.max("offset").alias("last"), F.countDistinct("base").alias("segments"))
    none = F.lit(0).cast("long")
    return ends.join(sums, "range_id", "left").select("range_id", F.coalesce("records", none).alias("records"), F.coalesce("bytes", none).alias("bytes"), F.coalesce(F.col("last") + 1, F.lit(start)).cast("long").alias("next_offset"), F.coalesce("segments", none).alias("segments"))


def isolate_oversized(records: DataFrame, max_bytes: int) -> DataFrame:
    """The records of topics without a record over ``max_bytes``: one such fails its topic and drops the topic's others too."""
    worst = records.groupBy("topic").agg(F.max("bytes").alias("largest"))
    return records.join(worst.where(F.col("largest") <= max_bytes).select("topic"), "topic", "left_semi")


def epoch_of(offsets: DataFrame, epochs: DataFrame) -> DataFrame:
    """The epoch that owns each offset: the last that starts at or before it, none below the first.

    As-of by one sort: epochs stand before the offsets that they own, and the last one
    is carried on.
    """
    marks = epochs.groupBy("range_id", "start_offset").agg(F.max("epoch").alias("epoch"))
    both = offsets.select("range_id", "offset", F.lit(1).alias("asked"), F.lit(None).cast("long").alias("epoch"), F.struct("*").alias("row"))
    starts = marks.select("range_id", F.col("start_offset").alias("offset"), F.lit(0).alias("asked"), F.col("epoch").cast("long"), F.lit(None).cast(both.schema["row"].dataType).alias("row"))
    upto = W.partitionBy("range_id").orderBy("offset", "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.unionByName(starts).withColumn("epoch", F.last("epoch", ignorenulls=True).over(upto)).where("asked = 1")
    return found.select("row.*", "epoch")


def lineage_divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two epoch vectors of a range first differ; a prefix agrees; a range with nothing to compare is unknown."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    both = l.join(r, ["range_id", "ordinal"], "full")
    met = F.col("l.epoch").isNotNull() & F.col("r.epoch").isNotNull()
    differ = met & ((F.col("l.epoch") != F.col("r.epoch")) | (F.col("l.start_offset") != F.col("r.start_offset")))
    at = F.when(differ, F.struct(F.col("ordinal"), F.least("l.start_offset", "r.start_offset").alias("at")))
    out = both.groupBy("range_id").agg(F.min(at).alias("first"), F.count_if(met).alias("met"))
    verdict = F.when(F.col("first").isNotNull(), "diverged").when(F.col("met") > 0, "agreed").otherwise("unknown")
    return out.select("range_id", verdict.alias("verdict"), F.col("first.at").alias("at"))


def greedy_batches(records: DataFrame, most: int, max_bytes: int) -> DataFrame:
    """Batch numbers by unit: a batch closes when the next record would exceed a limit.

    The running sums start anew with each batch, which no window can express; each
    unit is folded in order, a unit at a time.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        batch = count = total = 0
        out = []
        for size in rows["bytes"]:
            if count and (count >= most or total + size > max_bytes):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + size
            out.append(batch)
        return rows.assign(batch=out)

    return records.select("unit", "position", "bytes").groupBy("unit").applyInPandas(fold, "unit long, position long, bytes long, batch long")


def producer_verdicts(requests: DataFrame, window: int = 65_536) -> DataFrame:
    """Verdict and offset of each record that an idempotent producer asks to append, folded in arrival order by range.

    requests: range_id, position, group (records appended together), producer, epoch,
    sequence, code (a digest of the record).  A sequence seen before is a duplicate, which
    answers with its original offset, or a conflict if its code differs; an epoch below
    the producer's newest is fenced; an unknown (producer, epoch) must start at 0; below
    the window of the last ``window`` sequences nothing is known; all else must follow
    the last sequence.  The first error of a group rejects it: its other records are
    "rejected" and nothing of it is kept.  State belongs to the range, so sequences go on
    across its segments.  Positions are unique; null codes are equal to each other.
    A range's log is folded by one task in one pass; what it remembers is bounded by
    ``window`` for each (producer, epoch).
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        last: dict[tuple, int] = {}
        newest: dict[int, int] = {}
        seen: dict[tuple, dict[int, tuple]] = {}
        tip, verdicts, offsets = 0, [], []
        for _, group in rows.groupby("group", sort=False):
            fresh_last, fresh_newest, fresh_seen = {}, {}, {}  # what the group would change
            at, out = tip, []
            for producer, epoch, sequence, code in group[["producer", "epoch", "sequence", "code"]].itertuples(index=False):
                key, code = (producer, epoch), None if code != code else code
                known = fresh_seen.get((key, sequence)) or seen.get(key, {}).get(sequence)
                latest = fresh_last.get(key, last.get(key))
                if known is not None:
                    out.append(("duplicate", known[1]) if known[0] == code else ("conflict", None))
                elif epoch < fresh_newest.get(producer, newest.get(producer, epoch)):
                    out.append(("fenced", None))
                elif latest is None and sequence != 0:
                    out.append(("gap", None))
                elif latest is not None and sequence <= latest - window:
                    out.append(("below_window", None))
                elif latest is not None and sequence != latest + 1:
                    out.append(("gap", None))
                else:
                    out.append(("append", at))
                    fresh_last[key], fresh_seen[key, sequence] = sequence, (code, at)
                    fresh_newest[producer] = max(epoch, fresh_newest.get(producer, newest.get(producer, epoch)))
                    at += 1
            wrong = next((k for k, (v, _) in enumerate(out) if v not in ("append", "duplicate")), None)
            if wrong is None:
                tip = at
                last.update(fresh_last)
                newest.update(fresh_newest)
                for (key, sequence), value in fresh_seen.items():
                    seen.setdefault(key, {})[sequence] = value
                    seen[key].pop(sequence - window, None)
            else:
                out = [(v if k == wrong else "rejected", None) for k, (v, _) in enumerate(out)]
            verdicts += [v for v, _ in out]
            offsets += [o for _, o in out]
        ordered = pd.concat([g for _, g in rows.groupby("group", sort=False)]) if len(rows) else rows
        return ordered[["range_id", "position"]].assign(verdict=verdicts, offset=pd.array(offsets, dtype="Int64"))

    return requests.groupBy("range_id").applyInPandas(fold, "range_id long, position long, verdict string, offset long")


def producer_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("producer", "epoch").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count(F.lit(1)).alias("records"))


def committed_offset(replicas: DataFrame) -> DataFrame:
    """The k-th largest answering offset of each segment, k a majority of its replicas; else no quorum."""
    ranked = replicas.withColumn("rank", F.row_number().over(W.partitionBy("segment").orderBy(F.col("offset").desc_nulls_last())))
    k = F.floor(F.col("replication") / 2) + 1
    out = ranked.groupBy("segment", "replication").agg(F.count("offset").alias("answering"), F.max(F.when(F.col("rank") == k, F.col("offset"))).alias("boundary"), F.max(F.when(F.col("leader"), F.col("offset"))).alias("leader_offset"))
    verdict = F.when(F.col("answering") < k, "no_quorum").when(F.col("leader_offset") < F.col("boundary"), "leader_behind").otherwise("established")
    return out.select("segment", "answering", F.when(F.col("answering") >= k, F.col("boundary")).alias("boundary"), verdict.alias("verdict"))


def replica_lag(replicas: DataFrame) -> DataFrame:
    own = W.partitionBy("segment")
    reference = F.coalesce(F.max(F.when(F.col("leader"), F.col("offset"))).over(own), F.max("offset").over(own))
    return replicas.select("segment", "node", F.greatest(reference - F.col("offset"), F.when(F.col("offset").isNotNull(), F.lit(0))).alias("raw")).select("segment", "node", F.col("raw").alias("lag"))


def running_watermark(updates: DataFrame) -> DataFrame:
    """The high watermark each range shows: the least of update and local end, never going back."""
    upto = W.partitionBy("range_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    return updates.select("range_id", "position", F.max(F.least("update", "local")).over(upto).alias("high_watermark"))


def deletable_segments(segments: DataFrame, cursors: DataFrame) -> DataFrame:
    """Segments that no group cursor of their range still needs."""
    least = cursors.groupBy("range_id").agg(F.min("record_offset").alias("needed"))
    return segments.join(least, "range_id", "left").where(F.col("needed").isNull() | (F.col("needed") >= F.col("next_offset"))).drop("needed")


def place_replicas(scores: DataFrame, copies: int) -> DataFrame:
    """The best node of each failure domain, then the best ``copies`` of those, for each segment."""
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("node")]
    best, top = W.partitionBy("segment", "domain").orderBy(*order), W.partitionBy("segment").orderBy(*order)
    rows = scores.withColumn("rank", F.row_number().over(best)).where("rank = 1").withColumn("rank", F.row_number().over(top))
    return rows.where(F.col("rank") <= copies).select("segment", "rank", "node", "domain")


#: Arcs that a ring of scores is cut into; of each, as many nodes as there are copies reach the driver.
ARCS = 1 << 14


def place_on_ring(segments: DataFrame, nodes: DataFrame, factors: tuple[int, int], modulus: int, copies: int) -> DataFrame:
    """``place_replicas`` of every segment over every node, scored (segment * factor + node * factor) % modulus.

    segments: segment; nodes: node, domain.  A node's place is the rest of its product, and a
    segment ranks places downwards from modulus - 1 less the rest of its own, around the ring.
    The ring is cut into arcs.  Where a segment begins, it is scored against the whole arc; of
    the arcs then met, which depend on that arc alone, only the best node of each of the first
    ``copies`` domains can be among its own: any other has as many domains before it, for
    every segment of the arc.  So it is for nodes of one place, whose order is that of their
    keys.  Keys that are null or negative are scored against everything.
    """
    plain = lambda key: F.coalesce(F.col(key) >= 0, F.lit(False))
    arc = lambda place: F.floor(place * ARCS / modulus).cast("int").alias("arc")
    score = ((F.col("segment") * factors[0] + F.col("node") * factors[1]) % modulus).alias("score")
    starts = segments.where(plain("segment")).select("segment", arc(modulus - 1 - F.col("segment") * factors[0] % modulus))
    ring = nodes.where(plain("node")).groupBy((F.col("node") * factors[1] % modulus).alias("place"), "domain").agg(F.min("node").alias("node"))
    ring = ring.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy("node", "domain"))).where(F.col("rank") <= copies)
    ring = ring.select(arc(F.col("place")), "place", "node", "domain")
    firsts: dict[int, list] = {}
    for r in place_replicas(ring.withColumnsRenamed({"arc": "segment", "place": "score"}), copies).orderBy("segment", "rank").collect():
        firsts.setdefault(r.segment, []).append((r.node, r.domain))
    below, met = [], {}
    for k in [*range(ARCS), *range(ARCS)]:  # twice, as the last arc lies below the first
        met[k] = below
        found: dict = {}
        for node, domain in firsts.get(k, []) + below:
            found.setdefault(domain, (node, domain))
        below = list(found.values())[:copies]
    spark = segments.sparkSession
    kinds = ", ".join(f"{c} {dict(nodes.dtypes)[c]}" for c in ("node", "domain"))
    beyond = spark.createDataFrame([(k, *x) for k, some in met.items() for x in some], f"arc int, {kinds}")
    pairs = [
        starts.join(ring, "arc"), starts.join(F.broadcast(beyond), "arc"),
        segments.where(~plain("segment")).crossJoin(nodes), segments.where(plain("segment")).crossJoin(nodes.where(~plain("node"))),
    ]
    parts = [p.select("segment", "node", "domain", score) for p in pairs]
    return place_replicas(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), copies)


def catalog_conflicts(segments: DataFrame) -> DataFrame:
    """By range: segments that overlap any earlier one, and segments that repeat a slot."""
    before = W.partitionBy("range_id").orderBy("base_offset", "next_offset").rowsBetween(W.unboundedPreceding, -1)
    rows = segments.withColumn("reach", F.max("next_offset").over(before))
    return rows.groupBy("range_id").agg(F.count_if(F.col("base_offset") < F.col("reach")).alias("overlaps"), (F.count(F.lit(1)) - F.countDistinct("base_offset")).alias("repeated_slots"))


def startup_catalog(segments: DataFrame) -> DataFrame:
    """Each artifact of a start-up listing as active, sealed or quarantined, with the first reason that holds.

    segments: segment, range_id, name (segment id), base, next, slot (the parent lineage),
    active.  Reasons in order: a bad interval; a segment id that occurs twice; a slot
    (range, base) taken by differing content; two lineages for one base; an interval that
    overlaps an earlier one of its range; more than one active segment in a range.
    """
    count = lambda *by: F.count(F.lit(1)).over(W.partitionBy(*by))
    kinds = lambda c, *by: F.size(F.collect_set(c).over(W.partitionBy(*by)))
    before = W.partitionBy("range_id").orderBy("base", "next", "segment").rowsBetween(W.unboundedPreceding, -1)
    rows = segments.withColumn("ids", count("name", "range_id")).withColumn("ends", kinds("next", "range_id", "base")).withColumn("slots", kinds("slot", "range_id", "base"))
    rows = rows.withColumn("reach", F.max("next").over(before)).withColumn("open", F.sum(F.col("active").cast("int")).over(W.partitionBy("range_id")))
    reason = (
        F.when((F.col("base") < 0) | (F.col("next") < F.col("base")), "bad_interval").when(F.col("ids") > 1, "duplicate_id").when(F.col("ends") > 1, "slot_conflict")
        .when(F.col("slots") > 1, "lineage_conflict").when(F.col("base") < F.col("reach"), "overlap").when(F.col("active") & (F.col("open") > 1), "several_active")
    )
    verdict = F.when(reason.isNotNull(), "quarantined").when(F.col("active"), "active").otherwise("sealed")
    return rows.select("segment", verdict.alias("verdict"), reason.alias("reason"))


def segment_of(offsets: DataFrame, segments: DataFrame) -> DataFrame:
    """The first sealed segment of its range whose end lies beyond each offset (range_id, offset): segment and base, null past all.

    As-of by one sort from the far end, so no range condition is joined on.
    """
    asked = offsets.select("range_id", F.col("offset").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("struct<base:bigint,segment:bigint>").alias("held"))
    ends = segments.groupBy("range_id", "next").agg(F.min(F.struct(F.col("base").cast("long").alias("base"), F.col("segment").cast("long").alias("segment"))).alias("held"))
    ends = ends.select("range_id", F.col("next").alias("at"), F.lit(0).alias("asked"), "held")
    # at one place the offset stands after the segment that ends there, coming from above: it is not inside
    later = W.partitionBy("range_id").orderBy(F.col("at").desc(), F.col("asked").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = asked.unionByName(ends).withColumn("held", F.last("held", ignorenulls=True).over(later)).where("asked = 1")
    return found.select("range_id", F.col("at").alias("offset"), F.col("held.segment").alias("segment"), F.col("held.base").alias("base"))


def shared_assignments(members: DataFrame) -> DataFrame:
    """Ranges that more than one member of a group holds."""
    return members.groupBy("group_id", "range_id").agg(F.countDistinct("member").alias("holders")).where("holders > 1")
