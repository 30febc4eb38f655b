"""Operator 9: quality classifier with hierarchical empirical Bayes.

1. A logistic classifier of a text's shape gives each document its own evidence.
   It is fitted on at most ``fit_rows`` labelled rows, those of least id hash.
2. Grouped sums of that evidence by host and by path (host and path column) give
   site rates.  A host's rate is shrunk toward the global rate, a path's toward its
   host's; how strongly follows from the spread between sites (method of moments),
   so a sparse site stays near its prior.
3. A document's posterior odds are its own odds times the odds of its path against
   the global odds.  Its own evidence is left out of its site's sums, so that it
   counts once.  Documents under ``threshold`` are rejected.

Texts are read once: evidence is written as a table, and sites are summed from that.
Site sums cover all documents, combined map-side; they are rejoined by an equi-join
on (host, path) that salts hot sites.

Defined results: null text counts as empty, which the classifier scores like any text; null hosts and paths form groups of
their own; null ids and repeated rows give separate rows; with no usable labels, or
labels of one class, every text's evidence is one fixed value above ``threshold``'s
default, so nothing is rejected; labels that are null or contradict another row of
their id are left out; empty tables give no rows; other columns, whatever their
names, pass through ``good_documents``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checkpoint, least_hashed, salted_join, slices, small_batches

FEATURES = ("short", "repeat", "neighbour", "upper", "symbol", "digit", "pipe", "stop", "long", "lines", "bang", "vowel")
_UPPER = {c for c in range(65, 91)}
_SYMBOL = bytes(b for b in b"#$%&*+/<=>@[\\]^_`{|}~")
_KEEP_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_KEEP_LOWER = bytes(b for b in range(256) if not (97 <= b <= 122))
_KEEP_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_KEEP_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOL)
_KEEP_STOP = bytes(b for b in range(256) if b not in b".!?")


def shape(text: str | None) -> list[float]:
    """Numbers from about 0 to 1 that describe a text as a whole."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    size = len(data)
    upper = len(data.translate(None, _KEEP_UPPER))
    lower = len(data.translate(None, _KEEP_LOWER))
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len({*words})
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        1.0 / (1.0 + n / 20.0),
        1.0 - distinct / n ** 0.9 if n > 30 else 0.0,
        same / n,
        upper / (upper + lower + 1),
        min(1.0, 10.0 * len(data.translate(None, _KEEP_SYMBOL)) / size),
        min(1.0, 10.0 * len(data.translate(None, _KEEP_DIGIT)) / size),
        words.count(b"|") / n,
        min(1.0, 4.0 * len(data.translate(None, _KEEP_STOP)) / n),
        min(1.0, size / n / 20.0),
        1.0 - len({*lines}) / max(1, len(lines)),
        min(1.0, data.count(b"!!") / n),
        min(1.0, n / max(1, len(lines)) / 200.0),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and roots, and a constant."""
    return np.concatenate([np.ones((len(x), 1)), x, x * x, np.sqrt(np.abs(x))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, exclude: Column | None = None) -> np.ndarray:
    """Weights of ``expand(shape(text))``; at most ``fit_rows`` rows' features reach the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    if exclude is not None:
        known = known.where(~exclude)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    picked = [(r.id, r.y) for r in least_hashed(known, "id", fit_rows).select("id", "y").collect()]
    width = 1 + 3 * len(FEATURES)
    start = np.zeros(width)
    start[0] = 2.0
    if len({y for _, y in picked}) < 2:
        return start
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "id long, y int"))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    features = pandas_udf(lambda texts: pd.Series([shape(t) for t in texts]), "array<double>")
    rows = sample.select("y", features("text").alias("x")).collect()
    if len({r.y for r in rows}) < 2:
        return start
    z = expand(np.array([r.x for r in rows], float))
    y = np.array([r.y for r in rows], float)
    w = start
    penalty = np.full(width, 1.0)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def with_evidence(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` (text, ...) with p, the classifier's probability that a text is good, in place of the text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in slices(batches):
            z = expand(np.array([shape(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES)))
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p)], [*kept, "p"])

    return rows.mapInArrow(run, StructType([*rows.select(*kept).schema.fields, StructField("p", DoubleType())]))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The first part of a URL's path, from its slash on; null without one."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    return F.when(path != "", path)


def _concentration(mean: float, between: float) -> float:
    """Prior strength of a Beta law with this mean and variance, from 1 to 1e6."""
    return max(1.0, min(1e6, mean * (1 - mean) / max(between, 1e-9) - 1))


def _spread(sites: DataFrame, s: str, q: str, n: str) -> tuple[float, float, int, int]:
    """(mean, prior strength, documents, sites) of rows with sums s, sums of squares q and numbers n: one row to the driver."""
    rate = F.col(s) / F.col(n)
    within = F.greatest(F.col(q) / F.col(n) - rate * rate, F.lit(0.0))
    got = sites.agg(F.sum(s).alias("s"), F.sum(n).alias("n"), F.sum(F.col(n) * rate * rate).alias("r2"), F.sum(within).alias("noise"), F.count(F.lit(1)).alias("sites")).first()
    if not got.n:
        return 0.5, 1.0, 0, 0
    mean = got.s / got.n
    return mean, _concentration(mean, got.r2 / got.n - mean * mean - got.noise / got.n), got.n, got.sites


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict]:
    """(rows host_key, path_key, ps, n, hs, hn: sums and numbers of evidence by path and by host; global rate, prior strengths, documents) of rows (host_key, path_key, p)."""
    paths = checkpoint(scored.groupBy("host_key", "path_key").agg(F.sum("p").alias("ps"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = checkpoint(paths.groupBy("host_key").agg(F.sum("ps").alias("hs"), F.sum("pp").alias("hh"), F.sum("n").alias("hn"), F.count(F.lit(1)).alias("n")), "hosts")
    rate, host_k, documents, _ = _spread(hosts, "hs", "hh", "hn")
    _, path_k, _, sites = _spread(paths, "ps", "pp", "n")
    both = salted_join(paths.withColumnRenamed("n", "pn"), hosts.drop("hh"), ["host_key"], ["path_key"], sites)
    # written, so that its size is known when the join with all rows is planned
    return checkpoint(both.select("host_key", "path_key", "ps", F.col("pn").alias("n"), "hs", "hn"), "sites"), {"rate": rate, "host_k": host_k, "path_k": path_k, "documents": documents}


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def posterior(scored: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """``scored`` (host_key, path_key, p, ...) with host_rate, path_rate and score; a row's own p is left out of its rates.

    ``again``: the same rows' keys and p, to sum them by.
    """
    sites, prior = site_sums(scored if again is None else again)
    p, rate = F.col("p"), F.lit(prior["rate"])
    host = (F.col("hs") - p + prior["host_k"] * rate) / (F.col("hn") - 1 + prior["host_k"])
    path = (F.col("ps") - p + prior["path_k"] * F.col("host_rate")) / (F.col("n") - 1 + prior["path_k"])
    found = salted_join(scored, sites, ["host_key", "path_key"], ["p"], prior["documents"])
    found = found.withColumn("host_rate", host).withColumn("path_rate", path)
    odds = _logit(p) + _logit(F.col("path_rate")) - _logit(rate)
    return found.withColumn("score", 1 / (1 + F.exp(-odds))).drop("ps", "hs", "hn", "n")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", host: str | Column = "source", path: str | Column = "lang", fit_rows: int = 20_000, threshold: float = 0.5, exclude: Column | None = None, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, evidence, host_rate, path_rate, score, good; with ``keep`` also ``row``, the whole row.

    ``host`` and ``path`` are columns, such as ``host_of`` and ``path_of`` a URL.
    ``exclude`` is a predicate on ``id`` of labelled rows that the fit must not see.
    """
    small_batches(docs.sparkSession)
    weights = fit(docs, labels, id_col, text_col, label_col, fit_rows, exclude)
    key = lambda c: F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))
    whole = [F.struct("*").alias("row")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key(host).alias("host_key"), key(path).alias("path_key"), F.col(text_col).alias("text"), *whole)
    if keep:  # whole rows are scored twice rather than written
        out = posterior(with_evidence(rows, weights), with_evidence(rows.drop("row"), weights))
    else:
        out = posterior(checkpoint(with_evidence(rows, weights), "evidence"))
    return out.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("good"), *["row"] * keep)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    return score(docs, labels, id_col, text_col, keep=True, **options).where("good").select("row.*")
