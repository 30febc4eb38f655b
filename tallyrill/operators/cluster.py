"""Operators on a cluster's metadata: routing, leases, quorums, cursors, guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyrill.functions import ranges as K


def route_keys(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """The range (range_id, prefix, bits) that owns each key (id, key).

    One equi-join: each key is tried at the 65 possible lengths that exist in
    ``ranges``, so no inequality join is needed; as many lengths as the key space
    has been split at stand in one small array.
    """
    lengths = ranges.agg(F.collect_set("bits").alias("lengths"))  # 65 values at most
    tried = keys.crossJoin(F.broadcast(lengths)).select("id", "key", F.explode("lengths").alias("bits"))
    tried = tried.withColumn("prefix", F.col("key").bitwiseAND(K.mask(F.col("bits"))))
    return tried.join(ranges, ["bits", "prefix"]).select("id", "range_id")


def lineage_valid(lineages: DataFrame) -> DataFrame:
    """Whether a range's parents fit it: prefix, bits, generation, parents (array of prefix, bits, generation)."""
    p, own, n = F.col("parents"), (F.col("prefix"), F.col("bits")), F.size("parents")
    former = F.forall(p, lambda x: x["generation"] == F.col("generation") - 1)
    one, two = p.getItem(0), F.get(p, F.lit(1))
    is_child = (F.col("bits") == one["bits"] + 1) & (K.parent(*own) == one["prefix"])
    merged = (one["bits"] == two["bits"]) & (one["bits"] == F.col("bits") + 1) & (K.buddy(one["prefix"], one["bits"]) == two["prefix"]) & (K.parent(one["prefix"], one["bits"]) == F.col("prefix"))
    good = F.when(F.col("generation") == 0, (n == 0) & (F.col("bits") == 0)).when(n == 1, former & is_child).when(n == 2, former & merged).otherwise(False)
    return lineages.select("range_id", (K.valid(*own) & F.coalesce(good, F.lit(False))).alias("valid"))


def quorum_acks(replicas: DataFrame) -> DataFrame:
    """Whether the leader and the followers that have all it has are a majority."""
    leader = F.max(F.when(F.col("leader"), F.col("offset"))).over(W.partitionBy("segment"))
    rows = replicas.withColumn("needed", leader)
    acks = F.count_if(~F.col("leader") & (F.col("offset") >= F.col("needed")))
    return rows.groupBy("segment", "replication").agg(acks.alias("acks")).select("segment", "acks", (1 + F.col("acks") >= F.floor(F.col("replication") / 2) + 1).alias("quorum"))


def truncate_epochs(epochs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Epochs that begin before their range's cut; ranges without a cut keep all. Each has its end."""
    rows = epochs.join(cuts, "range_id", "left").where(F.col("cut").isNull() | (F.col("start_offset") < F.col("cut")))
    stop = F.lead("start_offset").over(W.partitionBy("range_id").orderBy("start_offset", "epoch"))
    return rows.select("range_id", "epoch", "start_offset", F.coalesce(stop, F.col("cut")).alias("stop"))


def first_requests(commands: DataFrame) -> DataFrame:
    """Each request's original position: repeats answer with it and change nothing."""
    first = F.min("position").over(W.partitionBy("request_id"))
    return commands.select("position", "request_id", first.alias("original"), (F.col("position") > first).alias("repeat"))


def stale_members(members: DataFrame, heartbeats: DataFrame, cutoff: Column) -> DataFrame:
    """Members whose last heartbeat lies before the cutoff, or who never sent one."""
    last = heartbeats.groupBy("member").agg(F.max("at").alias("last"))
    return members.join(last, "member", "left").where(F.col("last").isNull() | (F.col("last") < cutoff)).select("member", "last")


def newest_epochs(claims: DataFrame) -> DataFrame:
    """Claims of a producer's epoch in order; one below an earlier one is refused."""
    earlier = F.max("epoch").over(W.partitionBy("producer").orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    return claims.select("position", "producer", "epoch", F.coalesce(F.col("epoch") >= earlier, F.lit(True)).alias("accepted"))


def rebalance_verdicts(moves: DataFrame, placement: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first reason against a move (segment, from, to), or ok.

    placement: segment, node; nodes: node, domain, state, weight.
    """
    held = placement.join(nodes.select("node", "domain"), "node", "left").groupBy("segment").agg(F.collect_list(F.struct("node", "domain")).alias("held"))
    target = nodes.select(F.col("node").alias("to"), F.col("domain").alias("to_domain"), "state", "weight")
    rows = moves.join(held, "segment", "left").join(target, "to", "left")
    nodes_of = F.transform("held", lambda h: h["node"])
    clash = F.exists("held", lambda h: (h["node"] != F.col("from")) & (h["domain"] == F.col("to_domain")))
    reason = (
        F.when(F.col("held").isNull(), "no_placement").when(F.col("from") == F.col("to"), "same_node")
        .when(~F.array_contains(nodes_of, F.col("from")), "source_not_placed").when(F.array_contains(nodes_of, F.col("to")), "target_placed")
        .when(F.col("state").isNull() | (F.col("state") != "active") | (F.col("weight") < 1), "target_unfit")
        .when((F.size("held") > 1) & clash, "domain_taken").otherwise("ok")
    )
    return rows.select("segment", "from", "to", reason.alias("verdict"))


def retention_verdicts(segments: DataFrame, tiers: DataFrame, cursors: DataFrame) -> DataFrame:
    """The first reason against a segment's expiry, or ok.

    segments: segment, range_id, next_offset, state, root, intent, proof, policy;
    tiers: segment, root, version; cursors: range_id, record_offset.  A tier copy
    with another root refuses, whatever the policy says.
    """
    needed = cursors.groupBy("range_id").agg(F.min("record_offset").alias("needed"))
    copy = tiers.groupBy("segment").agg(F.max_by("root", "version").alias("copy"), F.max("version").alias("version"), F.count(F.lit(1)).alias("copies"))
    rows = segments.join(copy, "segment", "left").join(needed, "range_id", "left")
    reason = (
        F.when(F.col("state") != "verified", "not_verified").when(F.col("intent"), "rebalancing").when(F.col("proof"), "being_replaced")
        .when(F.col("copies").isNotNull() & (F.col("copy").isNull() | (F.col("copy") != F.col("root"))), "copy_differs")
        .when(F.col("copies").isNull() & ~F.col("policy"), "no_copy").when(F.col("needed") < F.col("next_offset"), "cursor_behind").otherwise("ok")
    )
    return rows.select("segment", reason.alias("verdict"))


def lease_fold(commands: DataFrame, epochs: int | None = None) -> DataFrame:
    """The answer to each lease command of a range, folded in order, with the epoch after it.

    commands: range_id, position, verb, node, at, duration, epoch.  A grant has no
    deadline and a holder only yields it by release; acquire takes a free or expired
    lease or the caller's own; renew needs holder and epoch and a deadline yet to
    come, which it never shortens; each grant or acquisition is a new epoch.
    A range's log is folded by one task in one pass; ranges are independent.  ``epochs``:
    claimed epochs are numbers modulo that.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        epoch, holder, until, live = 0, None, None, False
        out = []
        for verb, node, at, duration, claimed in rows.sort_values("position")[["verb", "node", "at", "duration", "epoch"]].itertuples(index=False):
            answer = "ok"
            expired = live and until is not None and at >= until
            if verb in ("acquire", "renew") and duration <= 0:
                answer = "bad_duration"
            elif verb == "grant":
                epoch, holder, until, live = epoch + 1, node, None, True
            elif verb == "acquire":
                if live and until is None:
                    answer = "no_deadline"
                elif live and holder != node and not expired:
                    answer = "held"
                else:
                    epoch, holder, until, live = epoch + 1, node, at + duration, True
            elif verb in ("renew", "release"):
                if not live:
                    answer = "no_lease"
                elif holder != node:
                    answer = "not_holder"
                elif claimed != (epoch % epochs if epochs else epoch):
                    answer = "epoch_mismatch"
                elif verb == "release":
                    live = False
                elif until is None:
                    answer = "no_deadline"
                elif expired:
                    answer = "expired"
                else:
                    until = max(until, at + duration)
            else:
                answer = "unknown_verb"
            out.append((answer, epoch))
        return rows.sort_values("position")[["range_id", "position"]].assign(answer=[x[0] for x in out], fencing_epoch=[x[1] for x in out])

    return commands.groupBy("range_id").applyInPandas(fold, "range_id long, position long, answer string, fencing_epoch long")


def cursor_fold(commits: DataFrame, generations: int | None = None) -> DataFrame:
    """The answer to each cursor commit of (group, range), in order.

    commits: group_id, range_id, position, expected (generation), segment, base, next, offset.
    The offset must lie in its segment, the generation must be the current one, and
    a cursor never goes back: within a segment it may stay, into another it must advance.
    ``generations``: expected generations are numbers modulo that.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        generation, at, segment, out = 0, None, None, []
        for expected, own, base, end, offset in rows[["expected", "segment", "base", "next", "offset"]].itertuples(index=False):
            if not base <= offset <= end:
                answer = "outside_segment"
            elif expected != (generation % generations if generations else generation):
                answer = "generation_mismatch"
            elif at is not None and (offset < at or own != segment and offset == at):
                answer = "backward"
            else:
                answer, generation, at, segment = "ok", generation + 1, offset, own
            out.append((answer, generation))
        return rows[["group_id", "range_id", "position"]].assign(answer=[x[0] for x in out], generation=[x[1] for x in out])

    return commits.groupBy("group_id", "range_id").applyInPandas(fold, "group_id long, range_id long, position long, answer string, generation long")


def reservations_fold(requests: DataFrame, scopes: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Memory reservations of a shard in order: the first full scope refuses, and nothing stays charged.

    requests: shard, position, kind, bytes (below 0: released).  ``scopes``: by kind,
    the (scope, limit) that it charges, in order.  Zero bytes are free.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        used: dict[str, int] = {}
        out = []
        for kind, size in zip(rows["kind"], rows["bytes"]):
            full = next((s for s, limit in scopes[kind] if size > 0 and used.get(s, 0) + size > limit), None)
            if full is None:
                for s, _ in scopes[kind]:
                    used[s] = max(0, used.get(s, 0) + size)
            out.append(full)
        return rows[["shard", "position"]].assign(refused_by=out)

    return requests.groupBy("shard").applyInPandas(fold, "shard long, position long, refused_by string")


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition: messages not yet committed and messages retained; without a commit all retained lag."""
    rows = ends.join(committed, ["topic", "partition"], "left")
    lag = F.greatest(F.col("latest") - F.coalesce("committed", "oldest"), F.lit(0))
    return rows.select("topic", "partition", lag.alias("lag"), (F.col("latest") - F.col("oldest")).alias("retained"))


def cluster_health(gauges: DataFrame) -> DataFrame:
    """Running nodes, whether just one leads, the newest term and the oldest acknowledgement known (-1: unknown)."""
    out = gauges.agg(F.sum("running").alias("running"), F.sum("leads").alias("leaders"), F.max("term").alias("term"), F.max(F.when(F.col("ack_age") >= 0, F.col("ack_age"))).alias("ack_age"))
    return out.select("running", (F.col("leaders") == 1).alias("one_leader"), "term", "ack_age")
