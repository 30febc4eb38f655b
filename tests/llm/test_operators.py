"""The training-data operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallyrill.llm import byte_bpe, components, exact_dedup, license_scan, media_columns, mixing, ngram_join, quality, queries, suffix_dedup, toxicity, warc_zip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing column names."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["alpha", "Beta", "gämma", "mit", "license"]) for _ in range(30_000))
    rows = [(1, None, None, None), (2, "", "x", "a"), (2, "", "x", "a"), (None, "one two", "x", None), (3, long, "x", "a"), (4, long, None, "b"), (5, "ab" * 400, "x", "b"), (5, "ab" * 400, "x", "b"), (6, " \t\n", "x", "c")]
    return spark.createDataFrame([(*r, 1, 2, "t") for r in rows], SCHEMA + ", size long, _keep_text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(rows, length):
    """Brute force; rows of one id must not share strings unless their texts are equal, as their order is by a hash."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        data = (text or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, m in zip(data, mask) if not m)
        out.append((doc, len(data), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("hot", [2048, 1])
def test_op1(docs, odd, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    for df in (docs.limit(60), odd, none):
        got = suffix_dedup.repeated_substrings(df, keep_text=True).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == covered(pairs(df), 100)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("length, token", [(400, 32), (300, 1), (33, 32), (20, 20), (6, 3)])
def test_op1_lengths(spark, docs, length, token):
    rnd = random.Random(length)
    passages = [bytes(rnd.choices(b"abcdefghij ", k=700)).decode() for _ in range(3)]
    rows = [(k, "x".join(bytes(rnd.choices(b"abc ", k=rnd.randrange(60))).decode() + p[rnd.randrange(100) :] for p in rnd.choices(passages, k=2))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").limit(15))
    got = suffix_dedup.repeated_substrings(df, length=length, token=token).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == covered(pairs(df), length)


def test_op1_one_id(spark):
    """Rows without an id, or of one id, fill several blocks and leave each string once."""
    rnd = random.Random(6)
    passage = bytes(rnd.choices(b"abcdefghij ", k=300)).decode()
    rows = [(None if k % 2 else 7, f"{rnd.random()}" + passage[: rnd.randrange(100, 300)]) for k in range(60)]
    got = suffix_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()
    kept = b"|".join(bytes(r.kept) for r in got)
    strings = {t.encode()[k : k + 100] for _, t in rows for k in range(len(t) - 99)}
    whole = sum(len(t) for _, t in rows)
    assert sum(r.n_removed for r in got) + len(kept) - 59 == whole and len(got) == 60
    again = suffix_dedup.repeated_substrings(spark.createDataFrame([(1, "|".join(bytes(r.kept).decode() for r in got))], "doc_id long, text string")).first()
    assert again.n_removed == 0 and strings  # nothing is left twice


def linked(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for k, (doc, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted([(rows[k][0], len(sets[k]), least[find(k)], links[k]) for k in range(len(rows))], key=repr)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_op2(docs, odd, none, words, percent):
    for df in (docs, odd, none):
        got = ngram_join.similar_sets(df, words=words, percent=percent).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got], key=repr) == linked(pairs(df), words, percent)


def test_op2_near_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", (1, 1, 7))
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for doc in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
        rows.append((doc, " ".join(w)))
    got = ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got], key=repr) == linked(rows, 3, 90)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_op3(docs, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    public = Tokenizer.from_file(path)
    for df in (docs.limit(50), odd, none):
        want = []
        for doc, text in pairs(df):
            ids = public.encode(text or "", add_special_tokens=False).ids
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            want.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(tuple, byte_bpe.encode_documents(df, path).collect()), key=repr) == sorted(want, key=repr)
    codec, rnd = byte_bpe.codec(path), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "1", "'s", "'ll", "<|endoftext|>", "!", "...", "中", "́", " ", "\x85", "\x1c", "ing", "0000"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert list(codec.encode(text)) == public.encode(text, add_special_tokens=False).ids


def test_op4(docs, odd, none):
    for df in (docs.limit(30), odd, none):
        text = pairs(df)
        got = media_columns.media_columns(df, keep_media=True).collect()
        want = sorted([(d, len((t or "").encode()), media_columns.pad((t or "").encode())) for d, t in text], key=repr)
        assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], key=repr) == sorted([(d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for d, n, p in want], key=repr)
        for r in got:
            payload = r.media[-r.payload_bytes :]
            assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
            assert [bytes(r.media[k.start : k.stop]) for k in r.keyframes] == [payload[k : k + 576] for k in range(0, len(payload), 576 * 16)]
    with pytest.raises(ValueError):
        media_columns.read_container(media_columns.write_container(b"\xff" * 576)[:-5])


def test_op5(docs, odd, none):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for df in (docs, odd, none):
        want = []
        for doc, text in pairs(df):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
            want.append((doc, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x[1] for x in at}))))
        got = license_scan.license_scan(df).collect()
        assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
        assert all({*r.base_labels.split(",")} <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in got)
    found = license_scan.Index().scan(b"Licensed under CC BY-NC 4.0.")
    assert found[3] == {"cc-by-nc"} and found[4] > 0.9


def test_op6_segments():
    rnd = random.Random(4)
    for _ in range(200):
        scores = [rnd.choice([-0.25, -0.25, -0.25, 1.0, 2.5]) for _ in range(rnd.randint(0, 40))]
        places = [k for k, s in enumerate(scores) if s > 0]
        got = toxicity.segments(places, [scores[k] for k in places], 0.25)

        def best(lo, hi):
            """Maximal segments by definition: the best one (the shortest of equals), then those on its sides."""
            if lo >= hi:
                return []
            s, _, i, j = max((sum(scores[i:j]), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1))
            return best(lo, i) + [(s, i, j - 1)] + best(j, hi) if s > 0 else []

        assert sum(g[0] for g in got) == pytest.approx(sum(x[0] for x in best(0, len(scores))))
        assert max((g[0] for g in got), default=0) == pytest.approx(max((x[0] for x in best(0, len(scores))), default=0))


def test_op6(spark, odd, none):
    sf = SF.replace("0.001", "0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.predicted for r in got if not r.toxic) / sum(1 - r.toxic for r in got)
    assert hit > 0.85 and false < 0.01
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 9 and toxicity.toxicity(none, labels).count() == 0


def test_op7(spark, docs, odd, none, same_rows):
    same_rows(queries.op7_mixing(spark, SF), queries.ORACLE_SQL["op7_mixing"])
    for df in (odd, none):
        rows = mixing.mix_plan(df).collect()
        assert len(rows) == df.count() and all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    big = mixing.mix_plan(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(0.95 * r.target <= r.taken <= 1.05 * r.target for r in big if r.source_size > 10_000) and len(big) > 3
    assert [mixing.salts(n) for n in (0, 10**6, 10**6 + 1, 3 * 10**10)] == [16, 16, 32, 2784]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix_plan(docs).agg(F.sum("copies")).first()[0]


def test_op8(spark, odd, none, same_rows):
    same_rows(queries.op8_exact_dedup(spark, SF), queries.ORACLE_SQL["op8_exact_dedup"])
    got = exact_dedup.exact_duplicates(odd, block_bytes=64).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.kept} == {(2, 3), (4, 2), (5, 2), (6, 1), (None, 1)} and len(got) == 9 and sum(r.kept for r in got) == 5
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.keep_one(odd).count() == 5


def test_op9(spark, odd, none):
    sf = SF.replace("0.001", "0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(d, labels, exclude=toxicity.held_out("id"))
    got = scored.withColumn("h", toxicity.held_out("doc_id")).where("h").join(labels, "doc_id").select("quality", "good").collect()
    assert sum(r.good for r in got if r.quality) >= 0.99 * sum(r.quality for r in got)
    assert sum(not r.good for r in got if not r.quality) >= 0.9 * sum(1 - r.quality for r in got)
    assert quality.good_documents(odd, labels.limit(0)).columns == odd.columns
    assert quality.score(none, labels).count() == 0


def test_op10(spark):
    rows = [(3, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (4, "u", ""), (1, "u", "<p>a"), (None, "u", "<p>a"), (9, "v", "ä" * 3000)]
    path = queries.shared_folder(spark, "test-archives")
    warc_zip.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc_zip.read_archives(spark.read.parquet(path), keep_payload=True).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    a, e, u = digest("<p>a"), digest(""), digest("ä" * 3000)
    want = [(3, 4, a, "revisit", 1), (1, 4, a, "response", None), (1, 4, a, "revisit", 1), (None, 4, a, "revisit", 1), (2, 0, e, "response", None), (4, 0, e, "revisit", 2), (9, 6000, u, "response", None)]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    for r in spark.read.parquet(path).collect():
        assert zipfile.ZipFile(io.BytesIO(r.content)).testzip() is None
    content = warc_zip.build_archive([("1", warc_zip.warc_record("response", "1", "u", a, 4, b"<p>a", None))], force64=True)
    assert zipfile.ZipFile(io.BytesIO(content)).testzip() is None
    assert [p for _, p in warc_zip.archive_records(lambda at, n: content[at : at + n], len(content))] == [b"<p>a"]
    empty = queries.shared_folder(spark, "test-archives")
    warc_zip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc_zip.read_archives(spark.read.parquet(empty)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name in ("exact_dedup", "near_dedup"):
            assert out.count() == out.select("text").distinct().count() <= docs.count()
        docs = exact_dedup.checkpoint(out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_op2_pruning(spark):
    """Sets with too many shingles of their own go before signatures; copies' and near copies' stay."""
    rnd = random.Random(5)
    shared = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(shared + [f"u{k}x{rnd.randrange(10**9)}" for _ in range(60)])) for k in range(200)]
    body = [f"b{k}" for k in range(200)]
    rows += [(1000 + k, " ".join(body[:k] + ["x"] + body[k + 1 :])) for k in range(20)] + [(2000, rows[0][1]), (None, rows[1][1]), (3000, ""), (3001, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    stay = {(r.id, r.none) for r in ngram_join.may_link(df, ngram_join.Links(80), 5, 10**6).collect()}
    assert {(1000 + k, False) for k in range(20)} <= stay
    assert stay <= {(1000 + k, False) for k in range(20)} | {(0, False), (1, False), (2000, False), (-1, True)}
    assert not ngram_join.may_link(df.limit(0), ngram_join.Links(80), 5, 0).collect()
