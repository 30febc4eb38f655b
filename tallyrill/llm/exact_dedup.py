"""Operator 8: exact dedup by deterministic block naming.  DataFrame functions only.

Texts are cut into fixed-size byte blocks; the distinct blocks are dealt by hash,
sorted and named by integers in that order; adjacent names are paired and named
again, level by level, until each text has one name.  A name stands for one byte
string, so equal names mean equal texts: no collision is possible.

A text can only equal texts of its own length and 64-bit checksum.  Texts alone
with theirs need no name, and are not sent through the naming; the checksum never
decides that two texts are equal.

Shuffles are bounded: names come from distinct values (combined map-side), and the
joins that give names back to blocks and groups back to rows salt hot keys
(``salted_join``).  Nothing is sorted across tasks, so no blocks are sampled.

Defined results: null text counts as empty; null ids are least, so they stay only
where a group has no other; of repeated rows (one id, one text) one is kept; empty
tables give no rows; other columns are ignored by ``exact_duplicates`` and pass
through ``keep_one``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, possible, salted_join


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows of ``values`` with the number n of their occurrences, sorted in each part, each with an integer name."""
    counted = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return checkpoint(counted.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names")


def text_names(texts: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """(rid, level, name) for rows (rid, text) of unique rid: equal (level, name) means equal texts."""
    size = F.octet_length("text")
    cut = texts.select("rid", F.greatest(F.ceil(size / block_bytes), F.lit(1)).cast("long").alias("parts"), F.col("text").cast("binary").alias("bytes"))
    total, most = cut.agg(F.sum("parts"), F.max("parts")).first()
    blocks = cut.select("rid", "parts", "bytes", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("pos"))
    blocks = blocks.select("rid", "parts", "pos", F.substring("bytes", F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"))
    names = _named(blocks, ["block"])
    level, most, done = 0, most or 1, []
    named = checkpoint(salted_join(blocks, names, ["block"], ["rid", "pos"], total or 0).select("rid", "parts", "pos", "name"), "named")
    discard(names)
    while True:
        done.append(named.where(F.col("parts") == 1).select("rid", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = named.where(F.col("parts") > 1).groupBy("rid", "parts", F.expr("pos div 2").cast("int").alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
        names = _named(pairs, ["left", "right"])
        named = checkpoint(salted_join(pairs, names, ["left", "right"], ["rid", "at"], total).select("rid", F.expr("(parts + 1) div 2").alias("parts"), F.col("at").alias("pos"), "name"), "named")
        discard(names)
        most, level = (most + 1) // 2, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _shared(rows: DataFrame) -> tuple[DataFrame, int]:
    """((size, code, n) of more than one row, number of rows) for rows (size, code, ...)."""
    return rows.groupBy("size", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), rows.count()


def _groups(alike: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows rid, id, level, name; their groups level, name, keep (id, rid), n) of rows (rid, id, text)."""
    names = text_names(alike.select("rid", "text"), block_bytes)
    rows = checkpoint(alike.select("rid", "id").join(names, "rid"), "named-rows")
    return rows, rows.groupBy("level", "name").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id is kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("code"), text.alias("text"))
    slim = checkpoint(whole.select("id", "size", "code", F.sha2("text", 256).alias("sha")), "slim")
    shared, total = _shared(slim)
    shared = checkpoint(shared, "shared")
    alone = salted_join(slim, shared, ["size", "code"], ["id"], total, "left_anti")
    alike = salted_join(whole, shared, ["size", "code"], ["id"], total, "left_semi").select("id", "text")
    alike = checkpoint(alike.withColumn("rid", F.monotonically_increasing_id()), "alike")
    rows, groups = _groups(alike, block_bytes)
    found = salted_join(rows, groups, ["level", "name"], ["rid"], total)
    found = found.join(alike.select("rid", F.sha2("text", 256).alias("sha")), "rid")
    found = found.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.unionByName(found).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """``docs`` without the rows that are exact copies of a kept one.

    Rows that repeat a kept row's id and text are dropped too.  Only rows that share
    length and checksum with another, and few others, are shuffled; only the former
    are written and named.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("code"))
    shared, total = _shared(whole.select("size", "code"))
    shared = checkpoint(shared, "shared")
    marked = possible(whole, shared, ["size", "code"], "marked")
    meets = lambda how: salted_join(marked.where("marked"), shared, ["size", "code"], ["id"], total, how)
    alike = checkpoint(meets("left_semi").select("row", "id", F.monotonically_increasing_id().alias("rid")), "alike")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    _, groups = _groups(alike.select("rid", "id", text.alias("text")), block_bytes)
    stay = groups.select(F.col("keep.rid").alias("rid"))
    kept = alike.join(stay, "rid", "left_semi").select("row")
    return kept.unionByName(meets("left_anti").select("row")).unionByName(marked.where("not marked").select("row")).select("row.*")
