"""Chunk proofs, and group commits by a second simulation in steps of a millisecond."""

import hashlib
import random

from tallyrill.functions import digests as D
from tallyrill.operators import recovery as V


def test_chunk_proofs():
    rnd = random.Random(1)
    for count in [*range(1, 18), 33, 100]:
        chunks = [rnd.randbytes(5) for _ in range(count)]
        leaves = [hashlib.sha256(b"leaf" + c).digest() for c in chunks]
        root = D.tree_root(leaves)
        for k in rnd.sample(range(count), min(count, 6)):
            proof = D.chunk_proof(leaves, k)
            assert D.proof_holds(root, chunks[k], k, count, proof)
            assert not D.proof_holds(root, b"other", k, count, proof) and not D.proof_holds(root, chunks[k], k, count, [*proof, root]) and not D.proof_holds(root, chunks[k], count, count, proof)
            assert count == 1 or not D.proof_holds(root, chunks[k], (k + 1) % count, count, proof)


def simulate(requests, most, max_records, max_bytes, delay):
    """(group, reason) of each request, watching the queue at every millisecond."""
    out, queue, arrivals, now, group, deadline = {}, [], list(enumerate(requests)), 0, 0, None
    while arrivals or queue:
        while arrivals and arrivals[0][1][0] <= now:
            queue.append(arrivals.pop(0))
        while queue:
            deadline = now + delay if deadline is None else deadline
            records, size = sum(r[1] for _, r in queue), sum(r[2] for _, r in queue)
            reason = "max_pending" if len(queue) >= most else "max_records" if records >= max_records else "max_bytes" if size >= max_bytes else None
            if reason is None and now >= deadline:
                reason = "single_request" if len(queue) == 1 else "max_delay"
            if reason is None:
                break
            taken = []
            while queue and (not taken or sum(r[1] for r in taken) + queue[0][1][1] <= max_records and sum(r[2] for r in taken) + queue[0][1][2] <= max_bytes):
                k, r = queue.pop(0)
                taken.append(r)
                out[k] = (group, reason)
                if sum(r[1] for r in taken) >= max_records or sum(r[2] for r in taken) >= max_bytes:
                    break
            group, deadline = group + 1, None
        now += 1
    return [out[k] for k in range(len(requests))]


def test_group_commits(spark):
    rnd = random.Random(2)
    rows, want = [], []
    for shard in range(12):
        at, requests = 0, []
        for _ in range(60):
            at += rnd.choice([0, 0, 1, 2, 9])
            requests.append((at, rnd.choice([1, 1, 2, 7, 20]), rnd.choice([1, 5, 30, 90])))
        rows += [(shard, k, *r) for k, r in enumerate(requests)]
        want += [(shard, k, *x) for k, x in enumerate(simulate(requests, 5, 10, 60, 4))]
    got = V.group_commits(spark.createDataFrame(rows, "shard long, position long, at long, records long, bytes long"), 5, 10, 60, 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {r for *_, r in want} == {"max_pending", "max_records", "max_bytes", "max_delay", "single_request"}
