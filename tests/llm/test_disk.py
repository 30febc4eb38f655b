"""What the pipeline's first stages write and shuffle beside their results, against the texts' bytes."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyrill.llm import common, exact_dedup, ngram_join, quality


@pytest.fixture
def texts(spark, tmp_path):
    """Incompressible texts, a few of them exact or near copies."""
    rnd = random.Random(5)
    rows = [(k, " ".join(f"{rnd.getrandbits(60):x}" for _ in range(200)), "en", f"s{k % 3}") for k in range(1200)]
    rows += [(2000 + k, rows[k][1], "en", "s0") for k in range(20)] + [(3000 + k, rows[30 + k][1] + " more", "en", "s1") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    return docs, docs.agg(F.sum(F.length("text"))).first()[0]


def left_by(spark, monkeypatch, tmp_path, run):
    """(result, bytes of the largest table written, of all tables left)."""
    monkeypatch.setattr(common, "_session_folder", lambda _: f"file://{tmp_path}/shared")
    size = lambda path: sum(os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet"))
    largest = []
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **o: largest.append(size(paths[0].removeprefix("file://"))) or read(self, *paths, **o))
    df = run()
    return df, max(largest, default=0), sum(map(size, glob.glob(f"{tmp_path}/shared/*")))


@pytest.mark.parametrize("stage", ["quality", "exact_dedup", "near_dedup"])
def test_tables_are_small(spark, texts, monkeypatch, tmp_path, stage):
    docs, total = texts
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    stages = {"quality": lambda: quality.good_documents(docs, labels), "exact_dedup": lambda: exact_dedup.keep_one(docs), "near_dedup": lambda: ngram_join.one_of_each(docs, words=5, percent=80)}
    df, largest, left = left_by(spark, monkeypatch, tmp_path, stages[stage])
    assert largest < total / 4 and left < total / 4
    rows = df.select("doc_id", "text").collect()
    assert len(rows) == len(set(rows)) and len(rows) == {"exact_dedup": 1220, "near_dedup": 1200}.get(stage, len(rows))


def test_possible_marks_all_that_are_there(spark, tmp_path):
    rows = spark.range(60000).withColumn("text", F.concat(F.lit("t"), "id"))
    for step, most in ((7, 0.35), (60001, 0.01)):
        keyed = rows.where(F.col("id") % step == step - 1).select("id", "text")
        got = common.possible(rows, keyed, ["id", "text"], "mark").where("mark")
        assert got.join(keyed, ["id", "text"]).count() == keyed.count() and got.columns == ["id", "text", "mark"]
        assert got.count() < most * 60000
