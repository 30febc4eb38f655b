"""Licence scans of edited notices against all alignments of every template."""

import random

import pytest

from tallyrill.llm import license_scan as L


def all_alignments(index, text):
    """(labels, best score, matches) by trying every template at every place."""
    words = text.translate(L._WORDS).split()
    labels, score, found = set(), 0.0, []
    for label, template, phrases, is_base, total, _ in index.templates:
        for o in range(-len(template), len(words) + 1):
            at = lambda j: words[o + j] if 0 <= o + j < len(words) else None  # noqa: E731, B023
            if any(at(i + j) != w for i, phrase in phrases for j, w in enumerate(phrase)):
                continue
            hit = [w for j, w in enumerate(template) if at(j) == w]
            cover = sum(index.idf[w] for w in hit) / total
            if is_base or cover >= L.COVER:
                labels.add(label)
                found.append((label, o, len(template), round(cover, 9)))
                score = max(score, cover * (1 - 0.5 ** len(hit)))
    return labels, score, sorted(found)


def same(index, text):
    labels, score, found = all_alignments(index, text)
    got = index.scan(text)
    assert got[3] == labels and got[4] == pytest.approx(score), text
    assert sorted((*m[:3], round(m[3], 9)) for m in got[5]) == found, text
    return labels


def test_notices_without_their_rarest_word():
    index = L.Index()
    assert same(index, b"this is available under the terms of the Eclipse Public License") == {"epl"}
    isc = "permission to use copy modify and or pass on this software for any purpose with or without fee is hereby granted"
    same(index, isc.encode())
    assert same(index, isc.replace("pass on", "share").encode()) == {"isc"}
    assert same(index, b"bound to the terms of the mozilla public license v 2 0") == {"mpl"}


def test_edited_notices():
    rnd, index, labels = random.Random(11), L.Index(), set()
    vocabulary = sorted({w for _, text, _ in L.NOTICES for w in text.split()}) + ["alpha", "beta"]
    for _ in range(3000):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 6))]
        for _ in range(rnd.randint(1, 3)):
            notice = rnd.choice(L.NOTICES)[1].split()
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(notice))
                notice[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
                notice = notice or ["alpha"]
            words += notice[rnd.choice([0, 0, 0, 1, 2]) :] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 4))]
        labels |= same(index, " ".join(words).encode())
    assert labels == {label for label, _, _ in L.NOTICES}


def test_idf_of_the_corpus(spark):
    rows = [(k, "the software is here " * (k % 3)) for k in range(30)] + [(30, None), (31, "Mozilla Public License; MIT license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = L.corpus_index(df, "text", L.BASE, L.NOTICES)
    own = {w: sum(w in {*(t or "").lower().replace(";", " ").encode().split()} for _, t in rows) for w in index.vocabulary}
    assert index.idf == {w: pytest.approx(L.math.log(33 / (0.5 + n))) for w, n in own.items()}
    assert {r.doc_id: r.labels for r in L.license_scan(df).collect()}[31] == "mit"
    same(index, b"the mozilla public license v 2 0 this is free and unencumbered software released into the public domain")


def test_base_columns_in_sql(spark, duck, docs_folder):
    """The contract's base columns by DuckDB, over whole tables."""
    duck.execute(f"CREATE OR REPLACE VIEW scanned AS SELECT * FROM read_parquet('{docs_folder}/documents.parquet')")
    sql = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x01-\x7F]', 'z', 'g')), '[0-9a-z]+') AS words FROM scanned),
  p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w),
  h AS (SELECT doc_id, k - 1 AS place, CASE WHEN words[k] = 'mit' AND words[k + 1] = 'license' THEN 'mit' WHEN words[k] = 'apache' AND words[k + 1] = 'license' THEN 'apache'
    WHEN words[k] = 'general' AND words[k + 1] = 'public' AND words[k + 2] = 'license' THEN 'gpl' END AS label FROM p)
SELECT w.doc_id, len(words) AS n_words, count(label) AS n_base, min(place) FILTER (label IS NOT NULL) AS first_word, max(place) FILTER (label IS NOT NULL) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN h ON w.doc_id = h.doc_id GROUP BY w.doc_id, len(words)"""
    want = sorted(duck.execute(sql).fetchall())
    got = sorted(tuple(r)[:6] for r in L.license_scan(spark.read.parquet(f"{docs_folder}/documents.parquet")).collect())
    assert got == want and any(r[2] for r in want)


@pytest.fixture(params=["sf0.001", "sf0.01", "sf0.1"])
def docs_folder(request):
    return f"/root/testdata/{request.param}"
