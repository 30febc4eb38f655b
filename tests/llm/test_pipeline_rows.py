"""The rows that each stage of the pipeline keeps, and those of run()."""

import random
from collections import Counter

from conftest import SF

import corpus_pipeline as P
from tallyrill.llm import mixing, quality
from tallyrill.llm.common import checkpoint, shared_folder


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + P.WORDS]) for k in range(max(1, len(w) - P.WORDS + 1))} if w else set()


def near_groups(rows):
    """Rows by component, all pairs compared; a row without words is one by itself."""
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= P.PERCENT * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    found = {}
    for r, g in zip(rows, group):
        found.setdefault(g, []).append(r)
    return list(found.values())


def test_rows_of_the_stages(spark):
    rnd = random.Random(8)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    prose = sorted((r for r in base.collect() if 60 <= len((r.text or "").split()) <= 300), key=lambda r: r.doc_id)[:8]

    def near(r, id_):
        w = r.text.split()
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        return (id_, " ".join(w), r.lang, r.source, r.n_chars)

    extra = [near(r, None) for r in prose for _ in range(2)] + [near(r, 77_000) for r in prose[:3] for _ in range(2)]
    extra += [(None, r.text, r.lang, r.source, r.n_chars) for r in prose[:4]] + [(None, " ".join(f"n{k}" for k in range(90)), "en", "s", 9)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    folder = shared_folder(spark, "test-pipeline")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), docs.columns

    good = checkpoint(P.good(spark, docs, folder))
    scored = quality.score(docs, labels, keep=True).collect()
    assert Counter(good.collect()) == Counter(r.row for r in scored if r.good)

    distinct = checkpoint(P.distinct(spark, good, folder))
    texts = {}
    for r in good.collect():
        texts.setdefault(r.text, []).append(-1 if r.doc_id is None else r.doc_id)
    assert Counter((r.text, -1 if r.doc_id is None else r.doc_id) for r in distinct.collect()) == Counter((t, max(ids)) for t, ids in texts.items())

    dissimilar = checkpoint(P.dissimilar(spark, distinct, folder))
    kept, groups = Counter(dissimilar.collect()), near_groups(distinct.collect())
    assert any(len(g) > 1 and all(r.doc_id is None for r in g) or len(g) > 2 for g in groups)
    assert sum(kept.values()) == len(groups)
    for g in groups:
        stay = [r for r in g if kept[r]]
        assert len(stay) == 1 and (stay[0].doc_id is None) <= all(r.doc_id is None for r in g)
        assert stay[0].doc_id == min((r.doc_id for r in g if r.doc_id is not None), default=None)

    mixed = P.mixed(spark, dissimilar, folder)
    plan = mixing.mix_plan(dissimilar, keep=True).collect()
    want = Counter()
    for r in plan:
        want[tuple(r.row)] += r.copies
    assert Counter(map(tuple, mixed.collect())) == +want

    encoded = P.run(spark, folder).collect()
    assert Counter(r.doc_id for r in encoded) == Counter(k[0] for k in want.elements())
