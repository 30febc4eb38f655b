"""Every query of the engine against its SQL, and vectors for the record functions."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tallyrill.functions import records as R
from tallyrill.operators import log as G
from tallyrill.operators import metrics as M
from tallyrill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_detect_record(spark):
    cases = {
        b"CEF:0|x": "cef", b"<134>a CEF:0|x": "cef", b"<134>a LEEF:1.0|x": "leef", b"<34>1 x": "syslog", b"<9999> x": "raw", b"<>": "raw", b"<12x>": "raw",
        b'{"a":1}': "jsonl", b' {"a":1}': "jsonl", b"[1,2,3]": "jsonl", b'{"a":1': "raw", b"123": "raw", b"true": "raw", b'"q"': "raw", b"": "raw", b"  ": "raw",
        b'{"a":1} x': "raw", b'{"a":1,"a":2}': "jsonl", b'{"a":NaN}': "raw", b'{"a":1e999}': "raw", b'{"a":"\xff"}': "raw", None: "raw",
    }
    df = spark.createDataFrame([(bytearray(k) if k is not None else None, v) for k, v in cases.items()], "value binary, want string")
    assert [(r.value, r.got) for r in df.withColumn("got", R.detect_record(F.col("value"))).collect() if r.got != r.want] == []


def test_replication_vectors(spark):
    rows = [(1, 1, True, 3, 100), (1, 2, False, 3, 90), (1, 3, False, 3, 50), (2, 1, True, 3, 1000), (2, 2, False, 3, 10), (2, 3, False, 3, 10), (3, 1, True, 3, 100), (3, 2, False, 3, None), (3, 3, False, 3, None), (4, 1, True, 3, 50), (4, 2, False, 3, 90), (4, 3, False, 3, 90)]
    df = spark.createDataFrame(rows, "segment int, node int, leader boolean, replication int, offset long")
    got = {r.segment: (r.boundary, r.verdict) for r in G.committed_offset(df).collect()}
    assert got == {1: (90, "established"), 2: (10, "established"), 3: (None, "no_quorum"), 4: (90, "leader_behind")}


def verdicts(spark, rows, **options):
    df = spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], "range_id long, position long, group long, producer long, epoch long, sequence long, code long")
    return [(r.verdict, r.offset) for r in G.producer_verdicts(df, **options).orderBy("position").collect()]


def test_producer_vectors(spark):
    rows = [(7, 1, 0, 5), (7, 1, 0, 5), (7, 1, 0, 6), (7, 1, 2, 5), (7, 2, 1, 5), (7, 2, 0, 5), (7, 1, 1, 5), (7, 1, 0, 5)]
    got = verdicts(spark, [(k, *r) for k, r in enumerate(rows)])
    assert got == [("append", 0), ("duplicate", 0), ("conflict", None), ("gap", None), ("gap", None), ("append", 1), ("fenced", None), ("duplicate", 0)]


def test_producer_groups_are_whole(spark):
    got = verdicts(spark, [(0, 1, 1, 0, 9), (0, 1, 1, 1, 9), (1, 1, 1, 2, 9), (1, 1, 1, 4, 9), (1, 1, 1, 3, 9), (2, 1, 1, 2, 8), (2, 1, 1, 2, 8), (2, 1, 1, 0, 9)])
    assert got == [("append", 0), ("append", 1), ("rejected", None), ("gap", None), ("rejected", None), ("append", 2), ("duplicate", 2), ("duplicate", 0)]


def test_producer_window(spark):
    rows = [(k, 1, 1, k, 5) for k in range(6)] + [(6, 1, 1, 3, 5), (7, 1, 1, 2, 5), (8, 1, 1, 2, 6), (9, 1, 1, 6, 5), (10, 1, 1, 3, 5)]
    assert [v for v, _ in verdicts(spark, rows, window=3)] == ["append"] * 6 + ["duplicate", "below_window", "below_window", "append", "below_window"]


def test_lineage_of_nothing(spark):
    left = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 0), (2, 2, 2, 9)], "range_id long, ordinal int, epoch long, start_offset long")
    right = spark.createDataFrame([(2, 1, 1, 0), (3, 1, 1, 0)], left.schema)
    assert {r.range_id: r.verdict for r in G.lineage_divergence(left, right).collect()} == {1: "unknown", 2: "agreed", 3: "unknown"}


def test_quantile_without_counts(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", float("inf"), 0), ("b", 1.0, 4), ("b", float("inf"), 9)], "k string, le double, cum long")
    got = {r.k: r.quantile for r in M.histogram_quantile(df, 0.9, "k").collect()}
    assert got["a"] != got["a"] and got["b"] == 1.0
