"""Shared helpers: tables in the shared folder, salted joins, packed column blocks, hashes.

The Python stages of these operators exchange *packed blocks*: numpy columns
compressed into one binary value.  A shuffle then moves a few large records
instead of one row per suffix or signature.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, in a folder of this application; see ``clear``.

    That is the one the cluster names in ``spark.checkpoint.dir``.  Only a local master
    (tests) may leave it unset; a temporary one is made then.
    """
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _session_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _own_folder()
    return f"{where.rstrip('/')}/tallyrill/{spark.sparkContext.applicationId}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    import tempfile

    return f"file://{tempfile.mkdtemp(prefix='checkpoints')}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has written in the shared folder; results not yet read go with them."""
    _delete(spark, _session_folder(spark))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as a table in the shared folder and read again, its lineage cut.

    Unlike a checkpoint of rows, the table is compressed and its size is known to
    the optimizer.  What was shuffled for it is removed at once, not when the driver
    happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


#: A key with more than one in so many of all rows is salted.
HOT_KEYS = 1024


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: list[str], total: int, how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with ``keyed``, which has one row a key and, as ``n``, the number of ``rows`` with it.

    Hot keys' rows are dealt over several tasks by the columns ``by``, and their row of
    ``keyed`` is repeated once for each.  Fewer than HOT_KEYS keys can be hot, as their
    rows add up to ``total`` at most, so the list of them is broadcast.
    """
    share = max(1, total // HOT_KEYS)
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = keyed.where(F.col("n") > share).select(*keys, salts.alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    every = F.when(F.col("n") > share, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(keyed.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how).drop("_salt")


#: Bits of a bitmap of keys for each of them, and the most of all, past which it only tells less.
KEY_BITS, MOST_BITS = 16, 1 << 27


def possible(rows: DataFrame, keyed: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """``rows`` with a boolean column ``mark``: true for all whose keys ``keyed`` has, and for a few others.

    What it says of the others is exact, so only the marked rows, not all texts, need be
    shuffled to meet ``keyed``, a written table, which may be too large to broadcast.  A
    bitmap of the keys' hashes is broadcast, of KEY_BITS for each.  No key may be null.
    """
    parts = -(-min(MOST_BITS, max(1, KEY_BITS * keyed.count())) // (1 << 15))
    place = F.pmod(F.xxhash64(*keys), F.lit(parts << 15))
    bits = keyed.select(place.alias("_place")).groupBy(F.shiftright("_place", 15).cast("int").alias("_part")).agg(F.bitmap_construct_agg(F.col("_place") % (1 << 15)).alias("_bits"))
    found = rows.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 15).cast("int")).join(F.broadcast(bits), "_part", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(F.col("_place") % (1 << 15), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn(mark, held).drop("_place", "_part", "_bits")


def least_hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of least hash of ``key`` (all, if fewer); only about that many are ordered, however many there are."""
    count = rows.count()
    if count > 2 * most:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(2 * most / count * (1 << 40)))
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(most)


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text: one aggregate row, whatever the corpus size."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return int(row[0]), int(row[1] or 0)


def block_count(total_bytes: int, least: int = 8) -> int:
    """Blocks to cut ``total_bytes`` into.

    A block grows with the square root of the corpus, from 6 MB or less up to
    256 MB, so that blocks times buckets grows only in proportion to the input.
    """
    block = min(256e6, max(1e6, 200 * math.sqrt(max(total_bytes, 1))))
    return max(least, math.ceil(total_bytes / block))


#: Rows in an Arrow batch, where the session has Spark's own number of 10,000: whole texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have Spark exchange Arrow batches of BATCH_ROWS rows with Python, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows are handed to a Python function so many bytes of text at a time.
SLICE = 4 << 20


def slices(batches, column: str = "text", most: int | None = None):
    """The rows of Arrow batches in order, in slices of at most that many bytes of text, or one row."""
    most = most or SLICE
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        release()


def release() -> None:
    """Give memory that a task has freed back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_library(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=1)
def _library():
    return ctypes.CDLL(None)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numpy numbers as one compressed value; see ``unpack``."""
    head = struct.pack("<B", len(columns))
    body = b""
    for c in columns:
        c = np.ascontiguousarray(c)
        head += struct.pack("<4sQ", c.dtype.str.encode()[:4].ljust(4), c.nbytes)
        body += c.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, columns = 1 + 12 * raw[0], []
    for k in range(raw[0]):
        kind, size = struct.unpack_from("<4sQ", raw, 1 + 12 * k)
        columns.append(np.frombuffer(raw, np.dtype(kind.decode().strip()), size // np.dtype(kind.decode().strip()).itemsize, at))
        at += size
    return columns


def unpack_all(values, columns: int) -> list[np.ndarray]:
    """The packed values' columns, each joined over all values."""
    parts = [unpack(v) for v in values if v is not None]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(columns)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def byte_codes() -> np.ndarray:
    """A fixed odd 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=U) * _BASE) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the rolling hash's base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, 1 << 16) + 1, base, U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = base**i times the polynomial hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U)
    np.cumsum(byte_codes()[data] * up[: len(data)], out=h[1:])
    return h


def slice_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Scrambled hashes of data[start:stop], which depend on content only."""
    _, down = powers(len(h))
    return mix((h[stop] - h[start]) * down[start] + (stop - start).astype(U))


#: The prime modulus and the base of the hash that decides whether strings are equal.
P61 = (1 << 61) - 1
_BASE61 = int.from_bytes(hashlib.sha256(b"words and stretches").digest()[:8], "little") % P61
_P = U(P61)


def _mod61(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> U(61))
    x -= _P * (x >= _P)
    return x


def multiply61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by halves of 31 bits: 2**61 is 1 there."""
    a1, a0, b1, b0 = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    middle = a1 * b0 + a0 * b1
    return _mod61((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & U(0x3FFFFFFF)) << U(31)) + a0 * b0)


def powers61(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo the prime."""
    if len(_powers.get("up61", ())) <= n:
        for name, base in (("up61", _BASE61), ("down61", pow(_BASE61, -1, P61))):
            p = np.ones(1, U)
            while len(p) <= max(n, 1 << 16):
                p = np.concatenate([p, multiply61(p, U(pow(base, len(p), P61)))])
            _powers[name] = p
    return _powers["up61"], _powers["down61"]


def prefix61(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of (byte + 1) * base**place, by the powers' low and high 32 bits; exact for up to 2**22 bytes."""
    if len(data) > 1 << 22:
        raise ValueError("too many bytes at once")
    up = powers61(len(data) + 1)[0][: len(data)]
    c = data.astype(U) + U(1)
    low, high = np.zeros(len(data) + 1, U), np.zeros(len(data) + 1, U)
    for out, part in ((low, up & U(0xFFFFFFFF)), (high, up >> U(32))):
        part *= c
        np.cumsum(part, out=out[1:])
    return low, high


def slice61(h: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Scrambled polynomials, modulo the prime, of data[start:stop], which depend on content only.

    Two strings of up to n bytes have one value for at most n of the 2**61 bases.
    """
    _, down = powers61(len(h[0]))
    low, high = _mod61(h[0][stop] - h[0][start]), _mod61(h[1][stop] - h[1][start])
    turned = ((high << U(32)) & _P) | (high >> U(29))  # times 2**32
    return mix(multiply61(_mod61(low + turned), down[start]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longer words are hashed one by one by a library's digest.
LONG_WORD = 1 << 16


def word_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words in each text); A-Z count as a-z.

    Words are runs of bytes outside ``space``; they never cross texts.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _LOWER[data]
    gap = space[data]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    start, stop = edge[0::2], edge[1::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    upto = np.searchsorted(start, ends, "left")
    size = stop - start
    long = np.flatnonzero(size > LONG_WORD)
    digests = [int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little") for k in long]
    if len(long):  # they are cut out of the data
        keep = np.ones(len(data), bool)
        for k in long:
            keep[start[k] : stop[k]] = False
        data = data[keep]
        size[long] = 0
        before = np.zeros(len(start), np.int64)
        before[long] = stop[long] - start[long]
        start = start - (np.cumsum(before) - before)
        stop = start + size
    hashes = slice61(prefix61(data), start, stop)
    hashes[long] = np.array(digests, U)
    return hashes, np.diff(upto, prepend=0)
