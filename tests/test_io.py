"""Scans, stores, manifests and streams, on files of the tests' own."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyrill.functions import digests as D
from tallyrill.functions import ranges as K
from tallyrill.operators import cluster as C
from tallyrill.operators import transfer as T
from tallyrill.sources import files, objects
from tallyrill.streaming import ingest


def test_lines_keep_bytes_and_leave_the_tail(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntw\xffo\ntail")
    (tmp_path / "b.log").write_bytes(b"")
    rows = files.lines(spark, str(tmp_path / "*.log")).orderBy("start_byte").collect()
    assert [(r.start_byte, r.end_byte, bytes(r.value)) for r in rows] == [(0, 5, b"one\r"), (5, 6, b""), (6, 11, b"tw\xffo")]
    starts = files.discover(spark, str(tmp_path / "a.log")).select(F.col("path").alias("source"), F.lit(6).cast("long").alias("start_byte"))
    assert [bytes(r.value) for r in files.lines(spark, str(tmp_path / "*.log"), starts).collect()] == [b"tw\xffo"]


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\n\x01")
    (tmp_path / "b.bin").write_bytes(b"")
    assert [bytes(r.value) for r in files.whole_files(spark, str(tmp_path), 3).collect()] == [b"\x00\n\x01"]
    with pytest.raises(Exception, match="byte budget"):
        files.whole_files(spark, str(tmp_path), 2).collect()


def test_topics_and_resume(spark):
    names = spark.createDataFrame([("app.a",), ("app.b.dlq",), ("x",)], "topic string")
    assert [r.topic for r in files.topics(names, r"^app\.", "dlq$").collect()] == ["app.a"]
    positions = spark.createDataFrame([("a", 5, 100, "1"), ("b", 5, 100, "2"), ("c", 5, 100, "3"), ("d", 5, 4, "4")], "source string, start_byte long, size long, identity string")
    committed = spark.createDataFrame([("a", 50, "1"), ("b", 50, "other")], "source string, end_byte long, identity string")
    assert {r.source: r.start_byte for r in files.resume(positions, committed).collect()} == {"a": 50, "b": 0, "c": 5, "d": 0}


def test_store_round_trip_and_damage(tmp_path):
    store = objects.LocalBackend(str(tmp_path))
    records = [b"a", b"b\n", b""]
    assert objects.frame(records) == b"a\nb\n\n" and objects.frame([b"aa", b"bb"], True) == b"aabb"
    for codec in ("gzip", "zstd", "none"):
        assert objects.decompress(objects.compress(b"x" * 999, codec, 99), codec) == b"x" * 999
    row = objects.store_batch(store, "t", records, {"end": 9}, key=b"k")
    assert row["state"] == "verified" and objects.verify_stored(store, "t", b"k") == "passed"
    assert objects.verify_stored(store, "t", b"other") == "failed" and objects.verify_stored(store, "none") == "missing"
    store.put("t.raw.zst", b"?" * row["object_bytes"])
    assert objects.verify_stored(store, "t", b"k") == "failed"
    with pytest.raises(ValueError):
        store.put("../x", b"")


def test_tree_root_splits_at_the_largest_power_of_two():
    def plain(leaves):
        if len(leaves) == 1:
            return leaves[0]
        half = 1 << (len(leaves) - 1).bit_length() - 1
        return hashlib.sha256(b"node" + plain(leaves[:half]) + plain(leaves[half:])).digest()

    for n in range(1, 40):
        leaves = [bytes([k]) * 32 for k in range(n)]
        assert D.tree_root(leaves) == plain(leaves)


def test_ingest_stream_and_again(spark, tmp_path):
    spool, out = tmp_path / "spool", str(tmp_path / "out")
    spool.mkdir()
    for k in range(5):
        (spool / f"{k}.log").write_bytes(b"line %d\n" % k)
    make = lambda: objects.LocalBackend(out)
    for _ in range(2):  # the second run finds nothing new
        query = ingest.ingest(ingest.file_stream(spark, str(spool)), make, str(tmp_path / "ledger"), str(tmp_path / "progress"))
        query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "ledger")).collect()
    assert len(rows) == 5 and {r.state for r in rows} == {"verified"}
    assert all(objects.verify_stored(make(), r.batch_id) == "passed" for r in rows)


def test_producer_stream(spark, tmp_path):
    data = str(tmp_path / "in")
    rows = [(1, 1, 0, 5, 0), (1, 1, 0, 5, 1), (1, 1, 0, 6, 2), (1, 1, 2, 5, 3), (1, 1, 1, 5, 4), (2, 1, 1, 5, 5)]
    schema = "producer long, epoch long, sequence long, code long, position long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(data)
    stream = ingest.appended(spark.readStream.schema(schema).parquet(data))
    query = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.answer for r in spark.table("answers").orderBy("position").collect()] == ["append", "duplicate", "conflict", "gap", "append", "gap"]


def test_key_ranges(spark):
    half = -(1 << 63)
    df = spark.createDataFrame([(0, 0), (half, 1), (half, 64), (1, 1)], "prefix long, bits int")
    p, b = F.col("prefix"), F.col("bits")
    got = df.select(K.valid(p, b).alias("v"), K.buddy(p, b).alias("buddy"), K.parent(p, b).alias("parent"), K.upper_child(p, b).alias("up"), K.contains(p, b, F.lit(-5)).alias("c")).collect()
    assert [r.v for r in got] == [True, True, True, False]
    assert [r.buddy for r in got[:3]] == [None, 0, half + 1] and [r.parent for r in got[:3]] == [None, 0, half]
    assert got[0].up.prefix == half and got[1].up.prefix == half | 1 << 62 and got[2].up is None
    assert [r.c for r in got] == [True, True, False, False]


def test_leases(spark):
    rows = [
        ("acquire", 1, 0, 10, 0, "ok", 1), ("acquire", 2, 5, 10, 0, "held", 1), ("renew", 1, 6, 1, 1, "ok", 1), ("renew", 1, 7, 9, 2, "epoch_mismatch", 1),
        ("acquire", 2, 10, 10, 0, "ok", 2), ("renew", 2, 20, 5, 2, "expired", 2), ("release", 2, 21, 0, 2, "ok", 2), ("grant", 3, 22, 0, 0, "ok", 3),
        ("acquire", 4, 99, 10, 0, "no_deadline", 3), ("renew", 3, 99, 5, 3, "no_deadline", 3), ("acquire", 3, 99, 0, 0, "bad_duration", 3),
    ]
    df = spark.createDataFrame([(0, k, *r[:5]) for k, r in enumerate(rows)], "range_id long, position long, verb string, node long, at long, duration long, epoch long")
    got = [(r.answer, r.fencing_epoch) for r in C.lease_fold(df).orderBy("position").collect()]
    assert got == [r[5:] for r in rows]


def test_cursors_and_reservations(spark):
    rows = [(0, 1, 0, 10, 5, "ok"), (0, 1, 0, 10, 6, "generation_mismatch"), (1, 1, 0, 10, 5, "ok"), (2, 2, 5, 20, 5, "backward"), (2, 2, 5, 20, 21, "outside_segment"), (2, 2, 5, 20, 6, "ok")]
    df = spark.createDataFrame([(0, 0, k, *r[:5]) for k, r in enumerate(rows)], "group_id long, range_id long, position long, expected long, segment long, base long, next long, offset long")
    assert [r.answer for r in C.cursor_fold(df).orderBy("position").collect()] == [r[5] for r in rows]
    asks = spark.createDataFrame([(0, k, "p", n) for k, n in enumerate([6, 5, 4, 1, 0, -4, 3])], "shard long, position long, kind string, bytes long")
    got = C.reservations_fold(asks, {"p": [("a", 100), ("b", 10)]}).orderBy("position").collect()
    assert [r.refused_by for r in got] == [None, "b", None, "b", None, None, None]


def test_verification_vectors(spark):
    cases = [(3, 3, None, None, None, "limited"), (3, 4, None, None, None, "failed"), (3, 3, "none", "ab", "ab", "failed"), (3, 3, "sha256", "AB", "ab", "passed"), (3, 3, "md5", "ab", "ab", "failed"), (3, 3, "sha256", None, "ab", "failed")]
    df = spark.createDataFrame(cases, "a long, b long, alg string, want string, got string, verdict string")
    rows = df.select("verdict", T.verify_content(*map(F.col, ("a", "b", "alg", "want", "got"))).alias("out")).collect()
    assert all(r.out == r.verdict for r in rows)
