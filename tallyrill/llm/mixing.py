"""Operator 7: mixing sources to target weights by systematic sampling.  DataFrame functions only.

Each source's target follows from its weight and size; each of its documents
expects target / size copies.  The expected copies are summed up within the
source, a random offset of the source (a hash of its name and the seed) is added,
and a document is emitted once per integer boundary its interval crosses.

Documents are summed in the order of their size (coarsely), so that a mix takes
near the target in words, not just in documents.  The order is a fixed one: size
step, salt (a hash of the id), size, id.  Counts by (source, size step, salt)
give each such cell its first place; ranks inside a cell the rest.  So a source
that holds a third of all rows is still ranked by many tasks, and the only rows
that one task orders by source are cell counts, whose number is bounded by size
steps times salts.  The number of salts grows with the root of the number of rows.
Sizes are counted once and written as a table.

Defined results: null text has size 0; null sources form one source, last in
order; null ids rank first in their cell; repeated rows count as rows; documents
of size 0 are taken as 0 words; empty tables give no rows; other columns pass
through ``mix`` and are ignored by ``mix_plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint

#: Salts for every million rows' root, a thousand.
SALTS = 16


def salts(rows: int) -> int:
    return SALTS * max(1, math.ceil(math.sqrt(rows) / 1000))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hex16(value: Column) -> Column:
    """0 to 65535 from a hash."""
    return F.conv(F.substring(F.md5(value), 1, 4), 16, 10).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets for rows (source_key, known, source_size): ``share`` of all sizes split by weight, at most ``most`` times a source's size.

    Sources reach their limit in the order of limit over weight; the level that
    those below the limit share is found by running sums over that order.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = W.orderBy(F.col("known").desc(), F.col("source_key"))
    w = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    w = w.withColumn("ratio", F.col("limit") / F.col("weight"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy("ratio", F.col("known").desc(), "source_key")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    since = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(since)
    w = w.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", level)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)
    w = w.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("limit")).otherwise(F.col("free.level") * F.col("weight"))
    return w.select("source_key", "known", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken; with ``keep`` also ``row``, the whole row."""
    whole = [F.struct("*").alias("row")] if keep else []
    rows = checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), n_words(F.col(text_col)).alias("size"), F.coalesce(F.col(source_col), F.lit("")).alias("source_key"), F.col(source_col).isNotNull().alias("known"), *whole), "sizes")
    rows = rows.withColumn("step", F.floor(F.sqrt("size"))).withColumn("salt", F.pmod(_hex16(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(salts(rows.count()))))
    cell = ["source_key", "known", "step", "salt"]
    cells = rows.select(*cell, "size").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy("source_key", "known").agg(F.sum("words").alias("source_size")), weights, share, most)
    by_cell = W.partitionBy("source_key", "known").orderBy("step", "salt").rowsBetween(W.unboundedPreceding, -1)
    first = cells.select(*cell, F.coalesce(F.sum("n").over(by_cell), F.lit(0)).alias("first")).join(targets, ["source_key", "known"])
    offset = (_hex16(F.concat(F.lit(seed), F.lit(":"), F.when(F.col("known"), F.col("source_key")).otherwise(F.lit("\u0000")))) + 0.5) / 65536.0
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy("size", "id"))).join(first, cell)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("first") + F.col("rank")
    copies = F.floor(place * F.col("each") + F.col("offset")) - F.floor((place - 1) * F.col("each") + F.col("offset"))
    out = ranked.withColumn("each", each).withColumn("offset", offset).withColumn("copies", F.least(copies, F.lit(int(-(-most // 1)))).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *["row"] * keep)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it has copies."""
    plan = mix_plan(docs, id_col, text_col, source_col, keep=True, **options)
    return plan.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
