"""one_of_each by rows: null ids, repeated ids and near copies against brute force."""

import random
from collections import Counter

import pytest

from tallyrill.llm import ngram_join


def component_of(rows, words, percent):
    """The component of each row, by comparing all pairs; a row without words is one by itself."""
    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


def near(rnd, body):
    k = rnd.randrange(len(body))
    return " ".join(body[:k] + [f"x{rnd.randrange(10**9)}"] + body[k + 1 :])


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 90)])
def test_one_row_of_each_component(spark, words, percent):
    rnd = random.Random(3)
    bodies = [[f"w{b}n{k}" for k in range(150)] for b in range(6)]
    rows = [(None, near(rnd, bodies[0])) for _ in range(5)]  # near copies, none with an id
    rows += [(None, near(rnd, bodies[1])) for _ in range(3)] + [(7, near(rnd, bodies[1])), (4, near(rnd, bodies[1]))]
    rows += [(9, near(rnd, bodies[2])), (9, near(rnd, bodies[2])), (9, " ".join(bodies[3]))]  # one id, two near copies and another text
    rows += [(9, near(rnd, bodies[4])), (2, near(rnd, bodies[4])), (2, " ".join(bodies[5])), (2, " ".join(bodies[5])), (-1, " ".join(bodies[5]))]
    rows += [(None, "alone here"), (None, "another text alone"), (None, ""), (None, ""), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.one_of_each(df, words=words, percent=percent).collect()]
    assert not Counter(got) - Counter(rows)
    groups = {}
    for row, g in zip(rows, component_of(rows, words, percent)):
        groups.setdefault(g, []).append(row)
    assert len(got) == len(groups)
    for members in groups.values():
        stay = [r for r in got if r in members]
        least = min((r[0] for r in members if r[0] is not None), default=None)
        assert all(r[0] == least for r in stay) and stay
    same = [tuple(r) for r in ngram_join.one_of_each(df.repartition(2, "text"), words=words, percent=percent).collect()]
    assert Counter(same) == Counter(got)
