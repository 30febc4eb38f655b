"""op6 and op9 with fitted models: odd rows, sites that change decisions, and the steps after the segment search, by brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallyrill.llm import quality, toxicity

BIG = SF.replace("0.001", "0.1")


def clip(x):
    return min(1 - 1e-6, max(1e-6, x))


def logit(x):
    return math.log(clip(x) / (1 - clip(x)))


def strength(sites):
    """Prior strength by the method of moments from a list of sites' lists of evidence."""
    n = sum(map(len, sites))
    mean = sum(map(sum, sites)) / n
    between = sum(len(s) * (sum(s) / len(s)) ** 2 for s in sites) / n - mean**2 - sum(max(0.0, sum(x * x for x in s) / len(s) - (sum(s) / len(s)) ** 2) for s in sites) / n
    return max(1.0, min(1e6, mean * (1 - mean) / max(between, 1e-9) - 1))


def by_hand(rows):
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, w, p in rows:
        hosts[h].append(p)
        paths[h, w].append(p)
    rate = sum(p for _, _, p in rows) / len(rows)
    hk, pk, out = strength(list(hosts.values())), strength(list(paths.values())), []
    for h, w, p in rows:
        host = (sum(hosts[h]) - p + hk * rate) / (len(hosts[h]) - 1 + hk)
        path = (sum(paths[h, w]) - p + pk * host) / (len(paths[h, w]) - 1 + pk)
        out.append((h, w, p, host, path, 1 / (1 + math.exp(-(logit(p) + logit(path) - logit(rate))))))
    return out


def test_sites_by_hand(spark, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for h, (n, bad) in enumerate([(400, 0.9), (400, 0.05), (3, 0.9), (1, 0.0), (900, 0.1), (50, 0.5)]):  # skewed and sparse
        for _ in range(n):
            w = rnd.randrange(1 + h)
            rows.append((f"h{h}", f"/{w}", rnd.uniform(0, 0.45) if rnd.random() < bad else rnd.uniform(0.4, 1)))
    rows += [("", "", 0.5), ("", "=x", 0.6)]
    want = by_hand(rows)
    df = spark.createDataFrame(rows, "host_key string, path_key string, p double").repartition(3)
    for least in (1024, 4):  # with hot sites salted too
        monkeypatch.setattr("tallyrill.llm.common.HOT_KEYS", least)
        got = [tuple(r) for r in quality.posterior(df).select("host_key", "path_key", "p", "host_rate", "path_rate", "score").collect()]
        assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
        assert np.allclose([x[2:] for x in sorted(got)], [x[2:] for x in sorted(want)])
    changed = [x for x in want if (x[2] >= 0.5) != (x[5] >= 0.5)]
    assert len(changed) > 50 and {True, False} == {x[5] >= 0.5 for x in changed}
    sparse = [x for x in want if x[0] in ("h2", "h3", "")]
    full = [x for x in want if x[0] == "h0"]
    shift = lambda xs: max(abs(logit(x[5]) - logit(x[2])) for x in xs)
    assert shift(sparse) < shift(full)  # a sparse site stays near its prior
    one = quality.posterior(spark.createDataFrame([("h", "/", 0.3)], df.schema)).first()
    assert quality.posterior(df.limit(0)).count() == 0 and one.score == pytest.approx(0.3)  # nothing else is known of its site


def test_sites_of_urls(spark):
    urls = [("https://User@Example.org:80/a/b?c#d", "example.org", "/a"), ("http://h", "h", None), ("h/x", None, None), (None, None, None), ("ftp://H/?q=/z", "h", "/")]
    df = spark.createDataFrame(urls, "url string, host string, path string")
    assert df.where(~quality.host_of(F.col("url")).eqNullSafe(F.col("host")) | ~quality.path_of(F.col("url")).eqNullSafe(F.col("path"))).count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "page_id long, quality int")
    got = quality.score(pages, labels, "page_id", "html", host=quality.host_of(F.col("url")), path=quality.path_of(F.col("url"))).collect()
    assert len(got) == pages.count() and all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents and labels for a fit, and odd rows: (docs, labels, number of odd rows)."""
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").first().text
    rows = [(-1, None), (-2, ""), (-2, ""), (None, " \t\n"), (-3, "word " * 400_000), (-4, "Alpha beta. " * 3), (-4, "Alpha beta. " * 3), (-5, toxic), (None, toxic), (-6, toxic * 300), (-7, "é" * 300_000)]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (-2, 1, 0), (-2, 0, 1), (-4, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))
    named = docs.unionByName(extra).withColumn("id", F.lit("x")).withColumn("p", F.lit(3)).withColumn("row", F.col("lang")).withColumn("held_out", F.lit(1))
    return named, more, len(rows)


def test_op9_odd_rows(odd):
    docs, labels, n = odd
    got = quality.score(docs, labels).where("doc_id < 0 or doc_id is null").collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.host_rate > 0 for r in got)
    assert len({r.evidence for r in got if r.doc_id in (-1, -2)}) == 1  # null is empty
    assert len({r.score for r in got if r.doc_id == -4}) == 1
    kept = quality.good_documents(docs, labels)
    good = {(r.doc_id, r.evidence, r.good) for r in got if r.good}
    assert kept.columns == docs.columns and kept.where("doc_id < 0 or doc_id is null").count() == sum(r.good for r in got) and good


def test_op6_odd_rows(odd):
    docs, labels, n = odd
    got = toxicity.toxicity(docs, labels, keep_passages=True).where("doc_id < 0 or doc_id is null").collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    low = min(r.score for r in got)
    assert all(r.score == low and not r.passages for r in got if r.doc_id in (-1, -2, -3, -4, -7))
    assert sorted(r.predicted for r in got) == [0] * (n - 3) + [1] * 3
    assert all(p.log_e < 0 and p.first_word <= p.last_word for r in got for p in r.passages)


def test_op6_evidence_by_hand():
    """Log E-values, their sum and the curve, from the definitions."""
    rnd = random.Random(9)
    scorer = toxicity.Scorer({b"foul ": 3.0, b"awfu": 2.0}, lam=1.3, k=0.4, curve=(-2.0, 1.5))
    for _ in range(200):
        words = [rnd.choice([b"foul", b"awful", b"fair", b"good", b"a"]) for _ in range(rnd.randrange(60))]
        weights = [{b"foul": 3.0, b"awful": 2.0}.get(w, -toxicity.DRIFT) for w in words]
        total, passages = scorer.evidence(words)
        for s, i, j, e in passages:
            assert s == pytest.approx(sum(weights[i : j + 1])) and e == pytest.approx(math.log(0.4 * len(words)) - 1.3 * s) and e < 0
        segments = toxicity.segments([k for k, w in enumerate(weights) if w > 0], [w for w in weights if w > 0], toxicity.DRIFT)
        assert total == pytest.approx(sum(max(0.0, 1.3 * s - math.log(0.4 * max(len(words), 1))) for s, _, _ in segments))
        assert scorer.score(total) == pytest.approx(1 / (1 + math.exp(2.0 - 1.5 * math.log1p(total))))


def test_op6_fit_by_hand(spark):
    """Weights are Dirichlet log-odds of the keys of labelled rows; lambda solves its equation; the curve has no better neighbour."""
    rnd = random.Random(10)
    common, foul = ["w" + chr(97 + k // 20) + chr(97 + k % 20) for k in range(300)], ["vile", "scum"]
    rows = []
    for k in range(400):
        words = rnd.choices(common, k=40) + (rnd.choices(foul, k=4) if k % 8 == 0 else [])
        rnd.shuffle(words)
        rows.append((k, " ".join(words), int(k % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 20_000)
    used = [r for r in rows if (r[0],) in {(x.doc_id,) for x in docs.where(~toxicity.held_out("doc_id")).select("doc_id").collect()}]
    counts, totals = defaultdict(lambda: [0, 0]), [0, 0]
    for _, text, y in used:
        once = {k for w in {*toxicity.words_of(text)} for k in toxicity.keys_of(w)}
        totals[y] += len(once)
        for k in once:
            counts[k][y] += 1
    want = {}
    for key, (clean, toxic) in counts.items():
        prior = 0.5 + 1000 * (clean + toxic) / sum(totals)
        odds = math.log((toxic + prior) / (totals[1] + 1000 - toxic - prior)) - math.log((clean + prior) / (totals[0] + 1000 - clean - prior))
        if toxic >= toxicity.LEAST_TEXTS and odds / math.sqrt(1 / (toxic + prior) + 1 / (clean + prior)) >= toxicity.LEAST_Z:
            want[key] = odds
    assert want and scorer.weights.keys() == want.keys() and all(scorer.weights[k] == pytest.approx(v) for k, v in want.items())
    assert {b"vile ", b"scum "} <= want.keys()
    texts = [(toxicity.words_of(t), y) for _, t, y in used]
    chance = [s for words, y in texts if not y for s, _, _ in scorer.found(words)] + [float(np.median(list(want.values())))]
    tokens = 1 + sum(len(w) for w, y in texts if not y)
    mean = lambda lam: sum(math.exp(lam * s) for s in chance) / tokens + (1 - len(chance) / tokens) * math.exp(-lam * toxicity.DRIFT)
    assert mean(scorer.lam) == pytest.approx(1, abs=1e-6)
    loss = lambda a, b: sum(math.log1p(math.exp(-(a + b * math.log1p(scorer.evidence(w)[0])) * (1 if y else -1))) for w, y in texts) + 0.005 * (a * a + b * b)
    a, b = scorer.curve
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
