"""Which keys may be weighted does not hang on the balance of the classes."""

import math
import random

from tallyrill.llm import toxicity as T


def test_keys_of_a_rare_class(spark):
    rnd = random.Random(2)
    # 1 % toxic: a key in 80 % of toxic and 1 % of clean texts has more clean texts than toxic ones
    rows = [(b"", 2_000_000, 20_000), (b"rare", 100, 80), (b"even", 9_900, 100), (b"few", 0, 4)]
    rows += [(f"k{k}".encode(), rnd.randint(0, 400), rnd.randint(0, 60)) for k in range(400)]
    counts = spark.createDataFrame([(bytearray(k), c, t) for k, c, t in rows], "key binary, clean long, toxic long")
    total = counts.first()
    want = set()
    for key, c, t in rows[1:]:
        prior = 0.5 + T.PRIOR * (c + t) / (total.clean + total.toxic)
        odds = math.log((t + prior) / (total.toxic + T.PRIOR - t - prior)) - math.log((c + prior) / (total.clean + T.PRIOR - c - prior))
        if t >= T.LEAST_TEXTS and odds / math.sqrt(1 / (t + prior) + 1 / (c + prior)) >= T.LEAST_Z:
            want.add(key)
    assert b"rare" in want and {k for k, c, t in rows[1:] if t <= c} & want
    assert {bytes(r.key) for r in T.telling(counts, total).collect()} == want


def test_a_rare_class_is_learnt(spark):
    rnd = random.Random(6)
    plain = lambda: [f"w{rnd.randrange(400)}" for _ in range(12)]
    rows = [(k, " ".join(plain() + (["vile"] * 3 if k % 50 == 0 and k % 500 else ["vile"] * (k % 37 == 0))), int(k % 50 == 0)) for k in range(4000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert T.fit(docs, labels, "doc_id", "text", "toxic", 20_000).weight(b"vile") > 0
