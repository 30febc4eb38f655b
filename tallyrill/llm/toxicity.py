"""Operator 6: toxicity by maximum-scoring segments.

1. Fit.  Word and word-start counts of labelled rows give log-odds with an
   informative Dirichlet prior (the prior of a key is half a count and its share);
   keys whose log-odds are many standard errors above zero get their log-odds as a
   weight, every other word costs DRIFT.
2. Scan.  One linear pass over a text's token weights finds all maximal-scoring
   segments, not just the best one.
3. Calibrate.  Scores of segments by chance follow an extreme-value law: lambda
   and K come from the clean training rows, so that a segment of score S in a text
   of n tokens has log E-value ln(K n) - lambda S.  A text's significant segments
   add up, and a logistic curve fitted on the training rows maps the sum to 0..1.

The fit reads at most ``fit_rows`` labelled rows, those of least id hash (a
documented bound); of texts with one least word shingle (copies and near copies)
one counts.  Scoring covers every text
whole.  Labels, ids, language and source are no inputs of a score.

Defined results: null text counts as empty; a text without a significant segment
gets the curve's lowest value; with no labelled rows, or with one class only, every
score is the share of label 1 (0 without any); rows with null ids are held in;
labels that are null or that contradict another row of their id are left out of the
fit; repeated rows give equal rows; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpoint, least_hashed, slices, small_batches
from .ngram_join import shingle_sets

#: Bytes A-Z as a-z; other ASCII than letters is a gap, bytes from 128 belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lengths in bytes of the word starts that count as keys beside whole words.
STARTS = (4, 5, 6, 7)
DRIFT, PRIOR, LEAST_Z, LEAST_TEXTS = 0.25, 1000.0, 3.0, 5


def held_out(id_col: str = "id"):
    """Whether crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def keys_of(word: bytes) -> list[bytes]:
    """The whole word, marked by a space, and its starts."""
    return [word + b" ", *[word[:n] for n in STARTS if len(word) >= n]]


def segments(places: list[int], weights: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last token) of a sequence that costs ``drift`` at every other place.

    Linear: candidates wait on a list; a new one swallows those that it improves.
    """
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, last = 0.0, -1
    for place, weight in zip(places, weights):
        total -= drift * (place - last - 1)
        low, first, total, last = total, place, total + weight, place
        high = total
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k -= 1
            if k < 0 or stack[k][1] >= high:
                break
            low, first = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((low, high, first, last))
    return [(b - a, i, j) for a, b, i, j in stack]


class Scorer:
    """Token weights and the calibration; see ``fit``."""

    def __init__(self, weights: dict[bytes, float], lam: float = 1.0, k: float = 1.0, curve: tuple[float, float] = (0.0, 0.0)):
        self.weights, self.lam, self.k, self.curve = weights, lam, k, curve
        self.known: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        return max((self.weights.get(k, 0.0) for k in keys_of(word)), default=0.0)

    def found(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        once = {*words}
        known = self.known
        if len(known) > 600_000:
            known.clear()
        for w in once.difference(known):
            known[w] = self.weight(w)
        hot = {w for w in once if known[w] > 0}
        if not hot:
            return []
        places = [k for k, w in enumerate(words) if w in hot]
        return segments(places, [known[words[k]] for k in places], DRIFT)

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[float, int, int, float]]]:
        """(summed significance, significant segments with their log E-values)."""
        base = math.log(self.k * max(len(words), 1))
        out = [(s, i, j, base - self.lam * s) for s, i, j in self.found(words)]
        out = [x for x in out if x[3] < 0]
        return sum(-x[3] for x in out), out

    def score(self, summed: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * math.log1p(summed)))))


def telling(counts: DataFrame, total) -> DataFrame:
    """Keys (key, clean, toxic) that could be weighted, whatever the balance of the classes; only these leave the executors."""
    prior = 0.5 + PRIOR * (F.col("clean") + F.col("toxic")) / float(max(1, total.clean + total.toxic))
    toxic, clean = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(toxic / (total.toxic + PRIOR - toxic)) - F.log(clean / (total.clean + PRIOR - clean))
    # a little below the least, as the driver's logarithms decide
    return counts.where((F.col("key") != F.lit(b"")) & (F.col("toxic") >= LEAST_TEXTS)).where(odds / F.sqrt(1 / toxic + 1 / clean) >= LEAST_Z - 1e-6)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> Scorer:
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    # the bounded sample's ids, at most fit_rows of them
    picked = [(r.id, r.y) for r in least_hashed(known, "id", fit_rows).select("id", "y").collect()]
    n = {y: sum(1 for p in picked if p[1] == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        share = n[1] / max(1, n[0] + n[1])
        return Scorer({}, curve=(math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0))
    chosen = F.broadcast(spark.createDataFrame(picked, "id long, y int"))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("y", F.coalesce("text", F.lit("")).alias("text"))
    # copies, near copies too, would make any word of theirs look telling: one text of a family counts
    family = pandas_udf(lambda texts: pd.Series([int(s.min().view(np.int64)) if len(s) else 0 for s in shingle_sets([t.encode() for t in texts], 3)], dtype="int64"), "long")
    sample = sample.groupBy(family("text").alias("h"), "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")

    def count(batches):
        for batch in slices(batches):
            got: dict[bytes, list[int]] = {}
            totals = [0, 0]
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                once = {k for w in {*words_of(text)} for k in keys_of(w)}
                totals[y] += len(once)
                for k in once:
                    got.setdefault(k, [0, 0])[y] += 1
            got[b""] = totals
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.int64())], ["key", "clean", "toxic"])

    counts = checkpoint(sample.mapInArrow(count, "key binary, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "keys")
    total = counts.where(F.col("key") == F.lit(b"")).first()
    weights: dict[bytes, float] = {}
    for r in telling(counts, total).collect() if total else []:
        prior = 0.5 + PRIOR * (r.clean + r.toxic) / (total.clean + total.toxic)
        odds = math.log((r.toxic + prior) / (total.toxic + PRIOR - r.toxic - prior)) - math.log((r.clean + prior) / (total.clean + PRIOR - r.clean - prior))
        if odds / math.sqrt(1 / (r.toxic + prior) + 1 / (r.clean + prior)) >= LEAST_Z:
            weights[bytes(r.key)] = odds
    trial = Scorer(weights)

    def scan(batches):
        for batch in slices(batches):
            ys, ns, best, every = [], [], [], []
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                got = trial.found(words)
                ys.append(y)
                ns.append(len(words))
                every.append([float(s) for s, _, _ in got])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array(every, pa.list_(pa.float64()))], ["y", "n", "s"])

    seen = sample.mapInArrow(scan, "y int, n long, s array<double>").collect()
    clean = [r for r in seen if r.y == 0]
    tokens = sum(r.n for r in clean) + 1.0
    chance = [s for r in clean for s in r.s]
    typical = float(np.median(list(weights.values()))) if weights else 1.0
    scores = np.array([*chance, typical])  # one more for what the sample has not shown
    low, high = 1e-6, 50.0
    for _ in range(80):  # lambda: the clean tokens' mean of exp(lambda * weight) is 1
        lam = (low + high) / 2
        mean = np.exp(np.minimum(lam * scores, 600)).sum() / tokens + (1 - len(scores) / tokens) * math.exp(-lam * DRIFT)
        low, high = (lam, high) if mean < 1 else (low, lam)
    least = float(scores.min())
    trial.lam, trial.k = low, (len(chance) + 0.5) / tokens * math.exp(min(low * least, 600))
    x = np.array([math.log1p(sum(max(0.0, low * s - math.log(trial.k * max(r.n, 1))) for s in r.s)) for r in seen])
    y = np.array([r.y for r in seen], float)
    trial.curve = logistic(x, y)
    trial.known = {}
    return trial


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(a, b) of the ridge-penalised logistic curve of y on x, b not negative."""
    z, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000, threshold: float = 0.7, keep_passages: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, n_passages [, passages].

    Passages are the significant segments: first and last word (from 0), score and
    log E-value.
    """
    small_batches(docs.sparkSession)
    scorer = fit(docs, labels, id_col, text_col, label_col, fit_rows)

    def run(batches):
        for batch in slices(batches):
            got = [scorer.evidence(words_of(t)) for t in batch.column("text").to_pylist()]
            scores = [scorer.score(g[0]) for g in got]
            passage = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))
            listed = [[{"first_word": i, "last_word": j, "score": s, "log_e": e} for s, i, j, e in g[1]] if keep_passages else None for g in got]
            columns = [batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([len(g[1]) for g in got], pa.int64()), pa.array(listed, passage)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "score", "predicted", "n_passages", "passages"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("held_out", held_out())
    schema = "id long, held_out boolean, score double, predicted int, n_passages long, passages array<struct<first_word:long,last_word:long,score:double,log_e:double>>"
    out = source.mapInArrow(run, schema)
    return (out if keep_passages else out.drop("passages")).withColumnRenamed("id", id_col)
