"""Operator 1: suffix-array dedup of repeated byte strings.

Every byte covered by a ``length``-byte string that also starts earlier (in a
row with a smaller id, or further left in the same row) is removed.

Method.  Sorting all suffixes of the corpus would shuffle many times its size.
So suffixes are sorted by *leading tokens*: content-defined tokens, cut at the
least ``token``-byte hash of each ``length``-byte window.  Equal windows have
the same least token at the same offset, so a pair of equal strings always
starts with the same token and nothing is missed.

1. Row blocks list the suffixes at token starts as (token, code of the stretch
   of all windows of that token, place).  Of equal stretches in a block only
   the earliest travels; the others are repeats.
2. Splitters sampled from (token, stretch) range-partition those suffixes;
   buckets sort by multikey quicksort and compare neighbours.  A stretch equal
   to an earlier one is a repeat as a whole.  A token that holds different
   stretches keeps the earliest of each; so does a token that equals a
   splitter, for its run may go on across the bucket boundary.
3. The few kept stretches fetch their bytes from their rows.  Sampled-splitter
   buckets take them; each sorts the suffixes at *all* window starts by
   multikey quicksort on the bytes themselves and marks every window equal to
   an earlier one.  A token with very many stretches would be one hot bucket:
   its windows travel alone instead, spread by content, duplicates within a
   block removed first.
4. Marked windows return to their rows' blocks.

Memory is bounded by blocks and buckets, whose sizes follow from the corpus
size alone.  Long rows are cut into overlapping pieces.  A stretch is compared by its
token's code, its token's offset and its bytes' polynomial modulo the prime 2**61 - 1;
windows are compared by their bytes.

Rows are dealt to blocks by id and text, so that rows of one id (null ids, say) do not
fill one block.

Defined results: null text counts as empty; null ids order before all others
and are returned as null; rows with one id (repeated rows) each give a row and
are ordered by a hash of their text, then by text; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, block_count, mix, pack, prefix61, prefix_hash, slice61, slice_hash, slices, small_batches, text_size, unpack_all

#: A piece of this many bytes is hashed at once.
PIECE = 1 << 18
#: A token with more different stretches than this has its windows spread by content.
HOT = 2048
#: Rows of one in so many are read for splitters, and about so many of their suffixes are kept for each bucket.
SAMPLE, PER_BUCKET = 61, 24


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a, n = np.minimum(a[:-n], a[n:]), 2 * n
    rest = width - n
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def stretches(rows: list[bytes], length: int, token: int):
    """Yield (token code, stretch code, row, token start, first window, windows) arrays of the rows' windows."""
    batch, size = [], 0
    for k, text in enumerate(rows):
        for at in range(0, max(len(text) - length + 1, 0), PIECE):
            piece = text[at : at + PIECE + length - 1]
            batch.append((k, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield _stretches(batch, length, token)
                batch, size = [], 0
    if batch:
        yield _stretches(batch, length, token)


def _stretches(batch, length, token):
    data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    sizes = np.array([len(p) for _, _, p in batch], np.int64)
    ends = np.cumsum(sizes)
    h = prefix_hash(data)
    place = np.arange(len(data) - token + 1)
    codes = slice_hash(h, place, place + token)
    # the place in the low bits: of equal codes the leftmost is the least
    least = sliding_min((codes & ~U(0xFFFFFF)) | place.astype(U), length - token + 1)
    anchor = (least & U(0xFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[piece]
    anchor[~inside] = -1
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first, last = np.concatenate([[0], cut]), np.append(cut, len(anchor)) - 1
    keep = anchor[first] >= 0
    first, last = first[keep], last[keep]
    anchor, piece = anchor[first], piece[first]
    stretch = slice61(prefix61(data), first, last + length) ^ mix((anchor - first).astype(U))
    shift = np.array([at for _, at, _ in batch], np.int64) - (ends - sizes)
    row = np.array([k for k, _, _ in batch], np.int64)[piece]
    return codes[anchor], stretch, row, anchor + shift[piece], first + shift[piece], last - first + 1


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: (order, new) over columns of keys, first column first.

    Only runs still tied in the columns so far are sorted by the next one; new
    marks where a row differs from the one before.
    """
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[0][order[1:]] != keys[0][order[:-1]]
    for column in keys[1:]:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        value = column[order[tied]]
        sub = np.lexsort((value, group))
        order[tied] = order[tied][sub]
        group, value = group[sub], value[sub]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        new[tied] = fresh
    return order, new


def earliest(run: np.ndarray, ids, rows, places) -> np.ndarray:
    """Of each run number the member that is earliest by (id, row, place): True there.

    ``rows`` that come from several blocks are numbered by (block, row in it).
    """
    order = np.lexsort((places, rows, ids, run))
    out = np.zeros(len(run), bool)
    head = np.ones(len(run), bool)
    head[1:] = run[order[1:]] != run[order[:-1]]
    out[order[head]] = True
    return out


def _block_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids (null: the least), whether null, and texts of a block, by (id, text)."""
    null = np.array([x is None for x in table.column("id").to_pylist()], bool)
    ids = table.column("id").fill_null(-(1 << 63)).to_numpy().astype(np.int64)
    texts = table.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], texts[k])), np.int64)
    return ids[order], null[order], [texts[k] for k in order]


def _out(**columns) -> pa.Table:
    kinds = {"bucket": pa.int32(), "block": pa.int32(), "data": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})


def _bucket_of(token: np.ndarray, stretch: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """splits: sorted (token, stretch) rows; the number of splitters at or below each suffix."""
    low, high = np.searchsorted(splits[:, 0], token, "left"), np.searchsorted(splits[:, 0], token, "right")
    for k in np.flatnonzero(high > low):
        low[k] += np.searchsorted(splits[low[k] : high[k], 1], stretch[k], "right")
    return low


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, token: int = 32, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans [, kept].

    ``spans`` lists the removed [start, stop) runs; ``keep_text`` adds the bytes
    that remain.
    """
    if not 0 < token <= length:
        raise ValueError("token must be from 1 to length")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    _, total = text_size(source)
    n = block_count(total)
    # suffixes at token starts come to about a third of the text's bytes
    buckets = n
    splits = _splitters(source, length, token, buckets, total)
    blocks = source.withColumn("block", F.pmod(F.xxhash64("id", F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(n)).cast("int"))
    count = np.min_scalar_type(length - token + 1)  # of a stretch's windows, and of a token's offset
    hot_tokens = np.unique(splits[:, 0]) if len(splits) else np.empty(0, U)

    def suffixes(key, table):
        ids, _, rows = _block_rows(table)
        parts = list(stretches(rows, length, token))
        if not parts:
            return _out(bucket=[], block=[], data=[])
        tok, code, row, at, first, many = (np.concatenate(x) for x in zip(*parts))
        order, new = multikey_order([tok, code])
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(new)
        head = earliest(run, ids[row], row, first)
        where = _bucket_of(tok, code, splits)
        where[~head] = -1 - key[0].as_py()  # repeats within the block need no comparison
        out_b, out_d = [], []
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        for s in np.split(order, cuts):
            b = int(where[s[0]])
            if b < 0:
                out_d.append(pack(row[s].astype(np.uint32), first[s].astype(np.int64), many[s].astype(count)))
            else:
                out_d.append(pack(tok[s], code[s], ids[row[s]], np.diff(row[s], prepend=0).astype(np.int32), np.diff(first[s], prepend=0).astype(np.int64), (at[s] - first[s]).astype(count), many[s].astype(count)))
            out_b.append(b)
        return _out(bucket=out_b, block=[key[0].as_py()] * len(out_b), data=out_d)

    def compare(key, table):
        """Buckets of suffixes: whole repeats (kind 0) and kept stretches (kind 1, hot ones 2), by block."""
        bucket = key[0].as_py()
        blocks_in, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        if bucket < 0:
            return pa.table({"block": pa.array(blocks_in, pa.int32()), "kind": pa.array([0] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})
        cols = []
        for b, d in zip(blocks_in, data):
            tok, code, ids, drow, dfirst, off, many = unpack_all([d], 7)
            cols.append((tok, code, ids, np.cumsum(drow), np.cumsum(dfirst), off, many, np.full(len(tok), b, np.int32)))
        tok, code, ids, row, first, off, many, block = (np.concatenate(x) for x in zip(*cols))
        order, new = multikey_order([tok, code])
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(new)
        head = earliest(run, ids, block.astype(np.int64) << 32 | row, first)
        tokens, which, _ = np.unique(tok, return_inverse=True, return_counts=True)
        variants = np.bincount(which[head], minlength=len(tokens))
        crosses = np.isin(tokens, hot_tokens)
        kept = head & ((variants > 1) | crosses)[which]
        kind = np.where(~head, 0, np.where(((variants > HOT) | crosses)[which], 2, 1))
        use = np.flatnonzero(~head | kept)
        out = []
        if len(use):
            use = use[np.lexsort((first[use], row[use], kind[use], block[use]))]
            cuts = np.flatnonzero((np.diff(block[use]) != 0) | (np.diff(kind[use]) != 0)) + 1
            for s in np.split(use, cuts):
                k = int(kind[s[0]])
                packed = pack(row[s].astype(np.uint32), first[s], many[s]) if k == 0 else pack(row[s].astype(np.uint32), first[s], many[s], tok[s])
                out.append((int(block[s[0]]), k, packed))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary())})

    def fetch(key, left, right):
        """The kept stretches' bytes, for buckets by token; repeats pass through under -1 - block."""
        block = key[0].as_py()
        ids, _, rows = _block_rows(left)
        kinds, data = right.column("kind").to_pylist(), right.column("data").to_pylist()
        out_b, out_d = [], []
        row, first, many = unpack_all([d for k, d in zip(kinds, data) if k == 0], 3)
        done = [(row.astype(np.uint32), first.astype(np.int64), first.astype(np.int64) + many + length - 1)]
        base = np.cumsum([0] + [len(t) for t in rows])
        text = np.frombuffer(b"".join(rows), np.uint8)
        for want in (1, 2):
            row, first, many, tok = unpack_all([d for k, d in zip(kinds, data) if k == want], 4)
            if not len(row):
                continue
            row, many = row.astype(np.int64), many.astype(np.int64)
            if want == 2:  # windows alone, the earliest of equal ones in this block, spread by content
                start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, tok = np.repeat(row, many), np.repeat(tok, many)
                first, many = start, np.ones(len(start), np.int64)
                words = _words(text, base[row] + first, length)
                order, new = multikey_order(list(words.T))
                run = np.empty(len(order), np.int64)
                run[order] = np.cumsum(new)
                head = earliest(run, ids[row], row, first)
                done.append((row[~head].astype(np.uint32), first[~head], first[~head] + length))
                spread = np.zeros(len(row), U)
                for c in range(words.shape[1]):
                    spread = mix(spread ^ words[:, c])
                row, first, many = row[head], first[head], many[head]
                where = (spread[head] >> U(32)).astype(np.int64) * buckets >> 32
            else:  # all stretches of a token meet in the bucket of its least splitter
                where = np.searchsorted(splits[:, 0], tok, "left")
            order = np.argsort(where, kind="stable")
            for s in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                size = many[s] + length - 1
                place = np.repeat(base[row[s]] + first[s] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out_b.append(int(where[s[0]]))
                out_d.append(pack(ids[row[s]], row[s].astype(np.uint32), first[s], many[s].astype(count), text[place]))
        row, start, stop = (np.concatenate(x) for x in zip(*done))
        if len(row):
            out_b.append(-1 - block)
            out_d.append(pack(*_merge(row, start, stop)))
        return _out(bucket=out_b, block=[block] * len(out_b), data=out_d)

    def sort_windows(key, table):
        """Buckets of stretches: their windows sorted by their bytes; spans of repeats by block."""
        bucket = key[0].as_py()
        blocks_in, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        if bucket < 0:
            return pa.table({"block": pa.array(blocks_in, pa.int32()), "data": pa.array(data, pa.binary())})
        cols = [[], [], [], [], []]
        texts = []
        for b, d in zip(blocks_in, data):
            ids, row, first, many, text = unpack_all([d], 5)
            for c, v in zip(cols, (ids, row.astype(np.int64), first, many.astype(np.int64), np.full(len(ids), b, np.int64))):
                c.append(v)
            texts.append(text)
        ids, row, first, many, block = (np.concatenate(c) for c in cols)
        text = np.concatenate(texts)
        size = many + length - 1
        base = np.cumsum(size) - size
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        which = np.repeat(np.arange(len(many)), many)
        words = _words(text, base[which] + inner, length)
        order, new = multikey_order(list(words.T))
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(new)
        start = first[which] + inner
        head = earliest(run, ids[which], (block << 32 | row)[which], start)
        again = np.flatnonzero(~head)
        out_b, out_d = [], []
        if len(again):
            b, r, s = block[which[again]], row[which[again]], start[again]
            o = np.argsort(b, kind="stable")
            for part in np.split(o, np.flatnonzero(np.diff(b[o])) + 1):
                out_b.append(int(b[part[0]]))
                out_d.append(pack(*_merge(r[part].astype(np.uint32), s[part], s[part] + length)))
        return pa.table({"block": pa.array(out_b, pa.int32()), "data": pa.array(out_d, pa.binary())})

    def remove(key, left, right):
        ids, null, rows = _block_rows(left)
        row, start, stop = unpack_all(right.column("data").to_pylist(), 3)
        row, start, stop = _merge(row.astype(np.uint32), start, stop)
        edge = np.searchsorted(row, np.arange(len(rows) + 1))
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for k, text in enumerate(rows):
            spans = [(int(a), int(b)) for a, b in zip(start[edge[k] : edge[k + 1]], stop[edge[k] : edge[k + 1]])]
            at, keep = 0, []
            for a, b in spans:
                keep.append(text[at:a])
                at = b
            keep.append(text[at:])
            rest = b"".join(keep)
            out["id"].append(None if null[k] else int(ids[k]))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(rest))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["spans"].append([{"start": a, "stop": b} for a, b in spans])
            out["kept"].append(rest if keep_text else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    listed = blocks.groupBy("block").applyInArrow(suffixes, "bucket int, block int, data binary")
    compared = listed.groupBy("bucket").applyInArrow(compare, "block int, kind int, data binary")
    fetched = blocks.groupBy("block").cogroup(compared.groupBy("block")).applyInArrow(fetch, "bucket int, block int, data binary")
    marked = fetched.groupBy("bucket").applyInArrow(sort_windows, "block int, data binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"
    result = blocks.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(remove, schema)
    return (result if keep_text else result.drop("kept")).withColumnRenamed("id", id_col)


def _merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a row joined; sorted by row and start."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    # rows apart by more than any stop, so that one running maximum serves all rows
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + row.astype(np.int64) * far)
    head = np.ones(len(row), bool)
    head[1:] = start[1:] + row[1:].astype(np.int64) * far > reach[:-1]
    head[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - row[first].astype(np.int64) * far


def _words(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings text[at : at + length] as rows of big-endian 64-bit words, the last word overlapping."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    if length < 8:
        out = np.zeros((len(at), 1), U)
        for k in range(length):
            out[:, 0] = (out[:, 0] << U(8)) | padded[at + k].astype(U)
        return out
    rolled = np.zeros(len(padded) - 7, U)
    for k in range(8):
        rolled = (rolled << U(8)) | padded[k : len(padded) - 7 + k].astype(U)
    steps = [*range(0, length - 7, 8)]
    if steps[-1] + 8 < length:
        steps.append(length - 8)
    return np.stack([rolled[at + s] for s in steps], axis=1) if len(at) else np.zeros((0, len(steps)), U)


def _splitters(source: DataFrame, length: int, token: int, buckets: int, total: int) -> np.ndarray:
    """buckets - 1 (token, stretch) splitters from the suffixes of one row in SAMPLE.

    Of those suffixes the distinct ones with a hash below a bound come to the driver.
    The bound follows from the bytes of the corpus and the number wanted, PER_BUCKET for
    each bucket: a token starts about every (length - token + 2) / 2 bytes.
    """
    expected = total / SAMPLE * 2 / (length - token + 2)
    bound = min((1 << 64) - 1, int(PER_BUCKET * buckets / max(expected, 1.0) * (1 << 64)))

    def sample(batches):
        for batch in slices(batches):
            rows = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            parts = list(stretches(rows, length, token))
            if parts:
                tok, code = (np.concatenate(x) for x in list(zip(*parts))[:2])
                low = mix(code ^ tok) <= U(bound)
                yield pa.RecordBatch.from_arrays([pa.array(x[low].view(np.int64)) for x in (tok, code)], ["tok", "code"])

    picked = source.where(F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(SAMPLE)) == 0)
    found = picked.mapInArrow(sample, "tok long, code long").distinct().collect()
    pairs = np.array(sorted((int(r.tok) % (1 << 64), int(r.code) % (1 << 64)) for r in found), U).reshape(-1, 2)
    if len(pairs) < buckets:  # too few rows to sample: tokens are spread evenly
        even = np.arange(1, buckets, dtype=U) * U((1 << 64) // buckets)
        return np.stack([even, np.zeros(len(even), U)], axis=1)
    return pairs[np.linspace(0, len(pairs) - 1, buckets + 1).astype(int)[1:-1]]
