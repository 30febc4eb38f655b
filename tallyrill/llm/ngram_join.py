"""Operator 2: n-gram Jaccard self-join by PartEnum signatures.

Rows with equal shingle sets form a class.  Two classes link when the Jaccard
similarity of their sets reaches the threshold.

Pruning.  Of a set that links with another at least percent per cent of the shingles
occur in that other set too.  Shingles are counted over all rows, by short codes (codes
that meet by chance only make a shingle look shared), and sets with more lone shingles
than that allows, which link with nothing, get no signatures.

Signatures.  Sizes fall into bands.  Sets of one band (or of its upper neighbour)
that link differ in at most k shingles, and k follows from the band's largest size.
The shingle domain is hashed into k + 1 parts, so linked sets agree in some part; a
signature is the hash of a set's shingles there.  Sets must not meet just because both
lack shingles in a part: where a set lacks them, the block of two parts around is hashed
into three and its subsets of two are enumerated, then the block of four parts, and so
on (LEVELS), as long as a subset is empty.  By the same count, linked sets have an equal
part within a block of two parts that differs in at most 1 shingle, within one of four
that differs in at most 3, and so on, so no link is lost on the way.

Candidates.  Equal signatures within a task are linked as a star and only the star's
centre travels on; packed buckets then link what is left.  Connected components of
those stars (a superset of the links) give candidate clusters.

Verification.  Every pair of classes within a cluster is compared on the sets
themselves: frequent shingles by matrix products, rare ones by postings.  A larger
cluster is compared chunk against chunk in separate tasks, so no task holds more
than two chunks, which are bounded in classes and in bytes.  Small clusters share
tasks, whose number follows from the clusters' bytes.  Pairs are never emitted: a
task returns link counts and a spanning star per component.  Link counts need all
pairs of a cluster, so this work grows with the square of a cluster.

Words and shingles are compared as 64-bit codes: a word's is a polynomial modulo the
prime 2**61 - 1 (a digest for a very long word), which two words of n bytes share for
at most n of the 2**61 bases.  A class is named by two such codes.

The texts of the sets that pass pruning are written as a table once; signatures and
verification read that table.

Defined results: null or empty text has an empty set, which links with nothing, and
its row is its own component; component_id is the smallest id reachable, so rows
with null ids take part, but never name a component of others; alone, a null id's
component is null; repeated rows are rows of one class; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, block_count, checkpoint, discard, mix, pack, possible, salted_join, slices, small_batches, text_size, unpack, unpack_all, word_hashes
from .components import components

#: Classes in a chunk: so many times the root of their cluster's number, within these bounds, ...
CHUNK = (3, 128, 2048)
#: ... and at most so many bytes of shingles; also the bytes and classes of a task of small clusters.
CHUNK_BYTES, TASK_BYTES, TASK_CLASSES = 4 << 20, 8 << 20, 512
#: A shingle in more than one member in DENSE of a cluster is compared by matrix product.
DENSE = 16
BAND = 1.5
#: Level l enumerates blocks of 2**l parts: (hashed into, subsets of).  A block there
#: differs in at most 2**l - 1 shingles, which is what a subset leaves out.
LEVELS = ((1, 1), (3, 2), (6, 3), (10, 3), (18, 3))
#: Signatures are made for sets of so many shingles at a time.
SHINGLES = 1 << 20


def bands(most: int) -> list[tuple[int, int]]:
    """Size bands (least, largest), until ``most`` lies in one."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * BAND))
        out.append((low, high))
        low = high + 1
    return out


#: Texts are hashed so many bytes at a time.
PIECE = 1 << 17


def _pieces(texts: list[bytes]):
    """(number of the text, piece of it), cut between words."""
    for k, text in enumerate(texts):
        at = 0
        while True:
            stop = at + PIECE
            while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
                stop += 1
            yield k, text[at:stop]
            at = stop
            if at >= len(text):
                break


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; fewer words make one shingle."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for k, piece in [*_pieces(texts), (len(texts), b"")]:
        if held and (k == len(texts) or size + len(piece) > PIECE and k != held[-1][0]):
            counts = np.zeros(held[-1][0] - held[0][0] + 1, np.int64)
            hashes = []
            step = 64 if size <= 2 * PIECE else 1  # pieces of a long text come one by one
            for at in range(0, len(held), step):
                some = held[at : at + step]
                h, n = word_hashes([p for _, p in some])
                hashes.append(h)
                np.add.at(counts, [j - held[0][0] for j, _ in some], n)
            out += _shingles(np.concatenate(hashes), counts, words)
            held, size = [], 0
        held.append((k, piece))
        size += len(piece)
    return out


def _shingles(hashes: np.ndarray, counts: np.ndarray, words: int) -> list[np.ndarray]:
    stops = np.cumsum(counts)
    n = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(n, U)
    for k in range(words):
        rolled = mix(rolled + hashes[k : n + k]) * U(0x9E3779B97F4A7C15)
    out = []
    for stop, count in zip(stops.tolist(), counts.tolist()):
        if count >= words:
            out.append(np.unique(rolled[stop - count : stop - words + 1]))
        elif count:
            h = np.array([count], U)
            for k in range(stop - count, stop):
                h = mix(h + hashes[k : k + 1]) * U(0x9E3779B97F4A7C15)
            out.append(h)
        else:
            out.append(np.empty(0, U))
    return out


def class_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set."""
    with np.errstate(over="ignore"):
        one = np.array([mix(s).sum(dtype=U) + U(len(s)) if len(s) else 0 for s in sets], U)
        two = np.array([(mix(s ^ U(0xA5A5A5A5A5A5A5A5)) * U(0x9E3779B97F4A7C15)).sum(dtype=U) ^ U(len(s)) if len(s) else 0 for s in sets], U)
    return mix(one), mix(two)


class Links:
    """The rule 100 * intersection >= percent * union, and the bounds that follow."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, largest: int) -> int:
        """The most shingles in which linked sets, both up to this size, differ."""
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    def smaller(self, size: int) -> int:
        """The least size that links with this one."""
        return -(-size * self.percent // 100)

    def holds(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)


def _sums(place: np.ndarray, x: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the shingles, their number) at each of ``total`` places, whatever their order."""
    value = mix(x + U(0x632BE59BD9B4E019))
    # sums of 32-bit halves are exact in doubles
    low = np.bincount(place, (value & U(0xFFFFFFFF)).astype(np.float64), total).astype(np.int64).astype(U)
    high = np.bincount(place, (value >> U(32)).astype(np.float64), total).astype(np.int64).astype(U)
    count = np.bincount(place, minlength=total)
    return mix(low * U(0x9E3779B97F4A7C15) + mix(high + count.astype(U))), count


def signatures(sets: list[np.ndarray], rule: Links) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes) or not sizes.max():
        return np.empty(0, U), np.empty(0, np.int64)
    listed = bands(2 * int(sizes.max()) + 2)
    lows = np.array([b[0] for b in listed])
    own = np.searchsorted(lows, sizes, "right") - 1
    differ = [rule.differ(b[1]) for b in listed]
    parts = [d + 1 if d else 0 for d in differ]
    jobs = []
    for k, (size, b) in enumerate(zip(sizes.tolist(), own.tolist())):
        if size and parts[b]:
            jobs.append((k, b))
        # sets of the next band that link with this one must not be smaller than that band's least
        if size and parts[b + 1] and rule.smaller(listed[b + 1][0]) <= size:
            jobs.append((k, b + 1))
    sigs, refs, at = [], [], 0
    while at < len(jobs):
        stop, held = at, 0
        while stop < len(jobs) and held < 1 << 18:
            held += len(sets[jobs[stop][0]])
            stop += 1
        _enumerate(jobs[at:stop], sets, parts, sigs, refs)
        at = stop
    return (np.concatenate(sigs), np.concatenate(refs)) if sigs else (np.empty(0, U), np.empty(0, np.int64))


def _enumerate(jobs, sets, parts, sigs, refs) -> None:
    n = np.array([parts[b] for _, b in jobs], np.int64)
    ref = np.array([k for k, _ in jobs], np.int64)
    band = np.array([b + 1 for _, b in jobs], np.int64)
    job = np.repeat(np.arange(len(jobs)), [len(sets[k]) for k, _ in jobs])
    x = np.concatenate([sets[k] for k, _ in jobs])
    h = mix(x ^ U(0x51ED270B))
    part = (h >> U(32)).astype(np.int64) * n[job] >> 32
    block_job = np.repeat(np.arange(len(jobs)), n)  # level 0: each part is a block
    block = np.arange(len(block_job)) - np.repeat(np.cumsum(n) - n, n)
    for level, (thirds, keep) in enumerate(LEVELS):
        code = block_job << 32 | block
        mine = job << 32 | part >> level
        at = np.minimum(np.searchsorted(code, mine), len(code) - 1)
        inside = code[at] == mine
        xs = x[inside]
        sub = (mix(xs ^ U(0x2545F491 * (level + 3))) >> U(32)).astype(np.int64) * thirds >> 32
        value, count = _sums(at[inside] * thirds + sub, xs, len(code) * thirds)
        value, count = value.reshape(-1, thirds), count.reshape(-1, thirds)
        name = mix((band[block_job] << 8 | level).astype(U) ^ mix(block.astype(U) + U(1)))
        lacks = np.zeros(len(code), bool)
        for c, subset in enumerate(combinations(range(thirds), keep)):
            sig = name + U(c)
            for j in subset:
                sig = mix(sig) ^ value[:, j]
            empty = count[:, subset].sum(1) == 0
            lacks |= empty
            some = slice(None) if level + 1 == len(LEVELS) else ~empty
            sigs.append(mix(sig)[some])
            refs.append(ref[block_job][some])
        if not lacks.any():
            return
        code = np.unique(block_job[lacks] << 32 | block[lacks] >> 1)
        block_job, block = code >> 32, code & 0xFFFFFFFF


def _codes(shingles: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, code of ``width`` bytes in it) of each shingle."""
    h = mix(shingles ^ U(0x3C6EF372FE94F82B))
    return (h >> U(32)).astype(np.int64) * buckets >> 32, (h & U((1 << 8 * width) - 1)).astype(np.uint32)


def lone_codes(sets: list[np.ndarray], buckets: int, width: int):
    """For each bucket: (bucket, numbers of the sets that alone have a code here, those codes' bytes, codes of several sets)."""
    number = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    bucket, code = _codes(np.concatenate(sets), buckets, width)
    key = bucket << 32 | code
    order = np.argsort(key, kind="stable")
    key, number = key[order], number[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    alone = head & np.append(head[1:], True)
    lone, number, several = key[alone], number[alone], key[head & ~alone]
    order = np.lexsort((number, lone >> 32))
    lone, number = lone[order], number[order]
    present = np.unique(key >> 32)
    a, b = (np.searchsorted(k >> 32, np.append(present, buckets)) for k in (lone, several))
    for k, where in enumerate(present.tolist()):
        low = (lone[a[k] : a[k + 1]] & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
        yield where, number[a[k] : a[k + 1]], low, (several[b[k] : b[k + 1]] & 0xFFFFFFFF).astype(np.uint32)


def may_link(source: DataFrame, rule: Links, words: int, total: int) -> DataFrame:
    """Ids (id, none) of rows whose sets do not have too many shingles of their own to link with another.

    Rows of a batch come in groups of bounded size, named by their content.  A group
    sends its codes to buckets; a bucket answers how many of each set's codes no other
    set has; the answers meet at the group's list of sets.
    """
    buckets = block_count(total)
    # a bucket's shingles, one every six bytes of text at least, leave most codes of that width free
    width = 3 if total / buckets < 6 * (1 << 21) else 4

    def announce(batches):
        for batch in slices(batches):
            sets = shingle_sets([(t.as_py() or "").encode() for t in batch.column("text")], words)
            c1, _ = class_of(sets)
            none = np.array(batch.column("id").is_null())
            ids = np.array(batch.column("id").fill_null(0))
            sizes = np.array([len(s) for s in sets], np.int64)
            order = np.lexsort((ids, none, c1))
            order = order[np.append(True, c1[order][1:] != c1[order][:-1])] if len(order) else order
            order = order[sizes[order] > 0]
            for some in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // SHINGLES)) + 1):
                if not len(some):
                    continue
                group = int(mix(mix(c1[some]) + ids[some].view(U)).sum(dtype=U).view(np.int64))
                allowed = np.array([n - rule.smaller(n) for n in sizes[some].tolist()], np.int64)
                out = [(-1 - group % buckets, pack(ids[some], none[some].astype(np.uint8), allowed))]
                for where, number, low, several in lone_codes([sets[k] for k in some], buckets, width):
                    step = np.diff(number, prepend=number[:1])
                    out.append((where, pack(step.astype(np.min_scalar_type(step.max(initial=0))), number[:1], low.T, several)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([group] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "group", "data"])

    def count(key, table):
        groups, data = table.column("group").to_pylist(), table.column("data").to_pylist()
        if key[0].as_py() < 0:
            return pa.table({"group": pa.array(groups, pa.int64()), "sets": pa.array(data, pa.binary()), "lone": pa.array([None] * len(data), pa.binary())})
        numbers, codes = [], []
        for value in data:
            step, first, low, several = unpack(value)
            wide = np.zeros((len(step), 4), np.uint8)
            wide[:, :width] = low.reshape(width, -1).T
            numbers.append(np.cumsum(step, dtype=np.int64) + (first[0] if len(first) else 0))
            codes += [wide.view("<u4").ravel(), several]
        _, inverse, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        once = times[inverse] == 1
        out, at = [], 0
        for k, number in enumerate(numbers):
            who, n = np.unique(number[once[at : at + len(number)]], return_counts=True)
            out.append(pack(who.astype(np.uint32), n.astype(np.uint32)))
            at += len(number) + len(codes[2 * k + 1])
        return pa.table({"group": pa.array(groups, pa.int64()), "sets": pa.array([None] * len(out), pa.binary()), "lone": pa.array(out, pa.binary())})

    def judge(table):
        ids, none, allowed = unpack(next(v for v in table.column("sets").to_pylist() if v is not None))
        who, n = unpack_all(table.column("lone").to_pylist(), 2)
        stay = np.bincount(who.astype(np.int64), n, len(ids)) <= allowed
        return pa.table({"id": pa.array(np.where(none, -1, ids)[stay], pa.int64()), "none": pa.array(none[stay] > 0)})

    sent = source.mapInArrow(announce, "bucket int, group long, data binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "group long, sets binary, lone binary")
    return counted.groupBy("group").applyInArrow(judge, "id long, none boolean").distinct()


def _of_ids(source: DataFrame, holders: DataFrame) -> DataFrame:
    """Rows of ``source`` with the ids (id, none) of a written table; those grow with the corpus, so they are never broadcast."""
    keyed = source.select(F.coalesce("id", F.lit(-1)).alias("_id"), F.col("id").isNull().alias("_none"), "id", "text")
    holders = holders.select(F.col("id").alias("_id"), F.col("none").alias("_none"))
    keyed = possible(keyed, holders, ["_id", "_none"], "_marked").where("_marked")
    return keyed.join(holders.hint("merge"), ["_id", "_none"], "left_semi").select("id", "text")


def stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their least node; edges a > b of the stars) of equal signatures."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    centre = node[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else node
    edge = np.unique(np.stack([node, centre], 1)[node != centre], axis=0) if len(sig) else np.empty((0, 2), np.int64)
    return sig[head], node[head], edge[:, 0], edge[:, 1]


def _packed(sig: np.ndarray, node: np.ndarray) -> bytes:
    """Sorted signatures as steps, their nodes by number."""
    nodes, number = np.unique(node, return_inverse=True)
    return pack(np.diff(sig, prepend=U(0)), nodes, number.astype(np.uint32))


def compare(sets_a: list[np.ndarray], sets_b: list[np.ndarray], rule: Links, same: bool) -> np.ndarray:
    """Boolean matrix of links between two lists of sets, exact."""
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    every = sets_a if same else sets_a + sets_b
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    x, inverse, df = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    both = np.zeros((len(sets_a), len(sets_b)), np.float32)
    a_side, b_side = (slice(0, len(sets_a)), slice(0, len(sets_b))) if same else (slice(0, len(sets_a)), slice(len(sets_a), len(every)))
    dense = np.flatnonzero((df > 1) & (df > len(every) / DENSE))
    for at in range(0, len(dense), 4096):
        column = np.full(len(x), -1, np.int64)
        some = dense[at : at + 4096]
        column[some] = np.arange(len(some))
        c = column[inverse]
        m = np.zeros((len(every), len(some)), np.float32)
        m[row[c >= 0], c[c >= 0]] = 1
        both += m[a_side] @ m[b_side].T
    rare = np.flatnonzero((df > 1) & (df <= len(every) / DENSE))
    if len(rare):
        wanted = np.zeros(len(x), bool)
        wanted[rare] = True
        pick = np.flatnonzero(wanted[inverse])
        pick = pick[np.argsort(inverse[pick], kind="stable")]
        r, e = row[pick], inverse[pick]
        start = np.concatenate([[0], np.flatnonzero(np.diff(e)) + 1])
        size = np.diff(np.append(start, len(e)))
        for k in np.unique(size).tolist():  # postings of one length at a time, as pairs
            s = start[size == k]
            for at in range(0, len(s), max(1, (1 << 21) // (k * k))):
                block = r[s[at : at + max(1, (1 << 21) // (k * k))][:, None] + np.arange(k)]
                i, j = np.repeat(block, k, 1).ravel(), np.tile(block, (1, k)).ravel()
                if not same:
                    use = (i < len(sets_a)) & (j >= len(sets_a))
                    i, j = i[use], j[use] - len(sets_a)
                both += np.bincount(i * len(sets_b) + j, minlength=both.size).reshape(both.shape) if both.size < 1 << 16 else _add(both, i, j)
    link = rule.holds(both.astype(np.int64), na[:, None], nb[None, :])
    if same:
        np.fill_diagonal(link, False)
    return link


def _add(both: np.ndarray, i: np.ndarray, j: np.ndarray):
    np.add.at(both, (i, j), 1)
    return 0


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_links.

    Rows link when 100 * intersection >= percent * union of their shingle sets;
    n_links counts the other rows that a row links with, equal sets included.
    """
    rows, named = _named_classes(docs, id_col, text_col, words, percent)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    full = named.join(least, "component").select("c1", "c2", "component_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("members").alias("n"))
    full = checkpoint(full, "named-classes")
    out = salted_join(rows.where("size > 0"), full, ["c1", "c2"], ["id"], rows.count()).select("id", F.col("size").alias("n_shingles"), "component_id", "n_links")
    empty = rows.where("size = 0").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty).withColumnRenamed("id", id_col)


def _named_classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with size, c1, c2; classes of the rows with shingles, with component and links).

    ``keyed``: rows have the SHA-256 of their text too, and classes the first of their rows (none, id, sha).
    """
    if not 70 <= percent <= 100:  # linked sizes must lie in one band or two neighbouring ones
        raise ValueError("percent must be from 70 to 100")
    small_batches(docs.sparkSession)
    rule = Links(percent)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    _, total = text_size(source)
    buckets = block_count(total)
    sha = ["sha"] if keyed else []

    def classify(batches):
        for batch in slices(batches):
            sets = shingle_sets([(t.as_py() or "").encode() for t in batch.column("text")], words)
            c1, c2 = class_of(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), *[batch.column(c) for c in sha]], ["id", "size", "c1", "c2", *sha])

    def sign(batches):
        """Packed signatures for a bucket from 0; packed star edges for one below 0."""
        for batch in slices(batches):
            sets = shingle_sets([(t.as_py() or "").encode() for t in batch.column("text")], words)
            c1, _ = class_of(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            _, once = np.unique(c1, return_index=True)
            out = []
            for some in np.split(once, np.flatnonzero(np.diff(np.cumsum(sizes[once]) // SHINGLES)) + 1):
                sig, ref = signatures([sets[k] for k in some], rule)
                sig, node, a, b = stars(sig, c1.view(np.int64)[some][ref])
                where = (sig >> U(32)).astype(np.int64) * buckets >> 32  # sorted, as sig is
                cut = np.flatnonzero(np.diff(where)) + 1
                out += [(int(where[s[0]]), _packed(sig[s], node[s])) for s in np.split(np.arange(len(sig)), cut) if len(s)]
                if len(a):
                    out.append((-1 - int(a[0] % buckets), pack(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "data"])

    def link(key, table):
        data = table.column("data").to_pylist()
        if key[0].as_py() < 0:
            a, b = unpack_all(data, 2)
        else:
            cols = [unpack_all([d], 3) for d in data]
            _, _, a, b = stars(np.concatenate([np.cumsum(c[0]) for c in cols]), np.concatenate([c[1][c[2]] for c in cols]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = source.withColumn("sha", _sha("text")) if keyed else source
    rows = checkpoint(texts.mapInArrow(classify, "id long, size long, c1 long, c2 long" + ", sha binary" * keyed), "classes")
    holders = checkpoint(may_link(source, rule, words, total), "holders")
    kept = checkpoint(_of_ids(source, holders), "kept")
    discard(holders)
    edges = kept.mapInArrow(sign, "bucket int, data binary").groupBy("bucket").applyInArrow(link, "a long, b long")
    clusters = components(edges)  # (node, component) over c1
    first = [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("first")] if keyed else []
    classes = rows.where("size > 0").groupBy("c1", "c2").agg(F.min("id").alias("least"), F.max("id").alias("some"), F.count(F.lit(1)).alias("members"), F.first("size").alias("size"), *first)
    wanted = checkpoint(classes.drop("first").join(clusters.select(F.col("node").alias("c1"), "component"), "c1"))
    return rows, _verified(kept, classes, wanted, rule, words)


def _sha(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _verified(kept: DataFrame, classes: DataFrame, wanted: DataFrame, rule: Links, words: int) -> DataFrame:
    """``classes`` with the component that each is in and the rows of other classes that it links with."""
    def fetch(batches):
        for batch in slices(batches):
            sets = shingle_sets([(t.as_py() or "").encode() for t in batch.column("text")], words)
            c1, c2 = class_of(sets)
            yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["c1", "c2", "shingles"])

    # A row of each candidate class: by id, then by the class of the text itself, as an id may repeat
    holders = checkpoint(wanted.select(F.coalesce("least", F.lit(-1)).alias("id"), F.col("least").isNull().alias("none")).distinct(), "holders")
    texts = _of_ids(kept, holders).select("text")
    sets = texts.mapInArrow(fetch, "c1 long, c2 long, shingles binary").groupBy("c1", "c2").agg(F.first("shingles").alias("shingles"))
    sizes = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("size")).alias("bytes")).where("n > 1")
    step, least, most = CHUNK
    chunk = F.greatest(F.lit(least), F.least(F.lit(most), step * F.sqrt("n")))
    chunks = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    sizes = checkpoint(sizes.withColumn("chunks", chunks), "clusters")
    small = sizes.where("chunks = 1").agg(F.sum("bytes"), F.sum("n")).first()
    tasks = max(1, -(-(small[0] or 0) // TASK_BYTES), -(-(small[1] or 0) // TASK_CLASSES))
    total = wanted.count()
    members = salted_join(wanted.join(sets, ["c1", "c2"]), sizes, ["component"], ["c1", "c2"], total)
    members = members.withColumn("own", F.pmod(F.xxhash64("c2", "c1"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # small clusters share a task by hash; a large one has a task for each pair of chunks
    task = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", low, high))
    members = members.select(task.alias("task"), "component", low.alias("low"), high.alias("high"), "own", "c1", "c2", "members", "shingles")

    def verify(key, table):
        columns = {c: table.column(c).to_pylist() for c in ("component", "low", "high", "own", "c1", "c2", "members", "shingles")}
        groups: dict[tuple, list[int]] = {}
        for k, g in enumerate(zip(columns["component"], columns["low"], columns["high"])):
            groups.setdefault(g, []).append(k)
        out: dict[tuple[int, int], list] = {}
        for (_, low, high), ks in groups.items():
            a = [k for k in ks if columns["own"][k] == low]
            b = a if low == high else [k for k in ks if columns["own"][k] == high]
            if not a or not b or low == high and len(a) < 2:
                continue
            read = lambda side: [np.frombuffer(columns["shingles"][k], U) for k in side]
            m = compare(read(a), read(b), rule, low == high)
            count_a, count_b = (np.array([columns["members"][k] for k in side], np.int64) for side in (a, b))
            for side, links in [(a, m @ count_b)] + ([(b, m.T @ count_a)] if low != high else []):
                for k, n in zip(side, links.tolist()):
                    if n:
                        out.setdefault((columns["c1"][k], columns["c2"][k]), [0, None])[0] += n
            # a spanning star of each component within this task
            nodes = a if low == high else a + b
            parent = list(range(len(nodes)))

            def root(v):
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            i, j = np.nonzero(np.triu(m) if low == high else m)
            for v in range(len(a)):  # one union a row and neighbour that is not joined yet
                for w in j[np.searchsorted(i, v) : np.searchsorted(i, v, "right")].tolist():
                    x, y = root(v), root(w if low == high else len(a) + w)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            for v, k in enumerate(nodes):
                r = nodes[root(v)]
                if r != k:
                    out.setdefault((columns["c1"][k], columns["c2"][k]), [0, None])
                    out[columns["c1"][k], columns["c2"][k]].append(columns["c1"][r])
        keys = list(out)
        return pa.table({
            "c1": pa.array([k[0] for k in keys], pa.int64()), "c2": pa.array([k[1] for k in keys], pa.int64()),
            "links": pa.array([out[k][0] for k in keys], pa.int64()), "to": pa.array([[r for r in out[k][2:]] for k in keys], pa.list_(pa.int64())),
        })

    verified = checkpoint(members.groupBy("task").applyInArrow(verify, "c1 long, c2 long, links long, to array<long>"))
    for read in (kept, wanted, holders, sizes):
        discard(read)
    linked = components(verified.select(F.col("c1").alias("a"), F.explode("to").alias("b")))
    degrees = verified.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    named = classes.join(linked.select(F.col("node").alias("c1"), "component"), "c1", "left").join(degrees, ["c1", "c2"], "left")
    return named.withColumn("component", F.coalesce("component", "c1"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each component, the first by (id, nulls last, SHA-256 of the text); rows without shingles all stay."""
    rows, named = _named_classes(docs, id_col, text_col, words, percent, keyed=True)
    key = lambda none, id_, sha: F.struct(F.coalesce(id_, F.lit(-1)).alias("id"), none.alias("none"), sha.alias("sha")).alias("own")
    counts = rows.groupBy(key(F.col("id").isNull(), F.col("id"), F.col("sha"))).agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    stay = firsts.select(key(F.col("first.none"), F.col("first.id"), F.col("first.sha"))).join(counts, "own").select("own", (F.col("rows") > 1).alias("repeats"))
    alone = counts.where("size = 0").select("own", F.lit(False).alias("repeats"))  # each row is a component by itself
    stay = checkpoint(stay.unionByName(alone), "stay")
    # most rows stay, so those are looked up that may not: only their texts are shuffled
    unsure = checkpoint(counts.select("own").join(stay.where("not repeats").hint("merge"), "own", "left_anti"), "unsure")
    id_ = F.col(id_col).cast("long")
    marked = possible(docs.select(F.struct("*").alias("row"), key(id_.isNull(), id_, _sha(text_col))), unsure, ["own"], "marked")
    # merged, not broadcast, as both sides grow with the corpus
    found = marked.where("marked").join(stay.hint("merge"), "own")
    # rows that repeat the kept id and text are copies of it; only those are compared by key
    again = found.where("repeats").dropDuplicates(["own"])
    return marked.where("not marked").select("row.*").unionByName(found.where("not repeats").select("row.*")).unionByName(again.select("row.*"))
