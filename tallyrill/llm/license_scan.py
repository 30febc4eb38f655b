"""Operator 5: licence scans by a positional rare-token index.

Templates are the passages of licence texts (``licenses``).  The index lists, for the
words of highest IDF of each template's mandatory phrases, the postings (template,
position).  Of a file's licence words the rarest are looked up first: a place of such a
word and a posting give an alignment, and the postings of the template's other rare
words are intersected at the same relative positions.  An alignment that all of them
share counts if the template's mandatory phrases stand there word for word and enough of
its IDF is covered.  Every match holds its mandatory phrases, so none is missed.

IDF is taken over the corpus: the number of rows that hold each word of the templates is
counted in one pass over all of them, and only these counts, one a word, reach the
driver.  ``Index`` alone takes it over the templates.

Defined results: null text counts as empty (no words, null positions, empty
labels, score 0); null ids and repeated rows give separate rows; empty tables give
no rows; other columns are ignored.  A match whose passage starts before the text does
has a negative first word.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .licenses import BASE, NOTICES

#: The least share of a notice's IDF that must stand in place.
COVER = 0.75

#: Bytes 0-9, a-z and from 128 stay, A-Z count as a-z, all else is a gap.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: So many rare words of a template's mandatory phrases are listed in the index.
RARE = 3


class Index:
    """The templates and their postings; ``counts``: rows of a corpus that hold each word, of so many ``rows``."""

    def __init__(self, base: dict[str, str] = BASE, notices=NOTICES, counts: dict[bytes, int] | None = None, rows: int = 0):
        self.listed = [(label, phrase, [phrase], True) for phrase, label in base.items()] + [(label, text, must, False) for label, text, must in notices]
        if counts is None:
            counts, rows = {}, len(self.listed)
            for _, text, _, _ in self.listed:
                for w in {*text.encode().split()}:
                    counts[w] = counts.get(w, 0) + 1
        self.vocabulary = {w for _, text, _, _ in self.listed for w in text.encode().split()}
        self.idf = {w: math.log((1 + max(rows, counts.get(w, 0))) / (0.5 + counts.get(w, 0))) for w in self.vocabulary}
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}  # by the rarest word of each template
        for k, (label, text, must, is_base) in enumerate(self.listed):
            words = text.encode().split()
            phrases = []
            for phrase in must:
                p = phrase.encode().split()
                phrases.append(next((i, p) for i in range(len(words)) if words[i : i + len(p)] == p))
            inside = sorted({i + j for i, p in phrases for j in range(len(p))}, key=lambda i: (-self.idf[words[i]], i))
            rare = [(words[i], i) for i in inside[:RARE]]
            self.templates.append((label, words, phrases, is_base, sum(self.idf[w] for w in words), rare[1:]))
            self.postings.setdefault(rare[0][0], []).append((k, rare[0][1]))

    def alignments(self, places: dict[bytes, list[int]]):
        """(template, place of its first word) where all of its rare words stand; ``places``: of the file's rare words, rarest first."""
        for word, at in places.items():
            for k, position in self.postings.get(word, ()):
                starts = {i - position for i in at}
                for other, p in self.templates[k][5]:
                    starts &= {i - p for i in places.get(other, ())}
                    if not starts:
                        break
                for o in sorted(starts):
                    yield k, o

    def scan(self, text: bytes) -> tuple:
        """(n_words, base places, base labels, labels, score, [(label, first word, words, cover)])."""
        words = text.translate(_WORDS).split()
        n = len(words)
        wanted = self.looked_up.intersection(words)
        places: dict[bytes, list[int]] = {w: [] for w in sorted(wanted, key=lambda w: (-self.idf[w], w))}
        for word, at in places.items():
            i = -1
            while True:
                try:
                    i = words.index(word, i + 1)
                except ValueError:
                    break
                at.append(i)
        base_at, base_labels, labels, score, found = [], set(), set(), 0.0, []
        for k, o in self.alignments(places):
            label, template, phrases, is_base, total, _ = self.templates[k]
            if any(o + p < 0 or words[o + p : o + p + len(q)] != q for p, q in phrases):
                continue
            hit = [w for j, w in enumerate(template) if 0 <= o + j < n and words[o + j] == w]
            cover = sum(self.idf[w] for w in hit) / total if total else len(hit) / len(template)
            if is_base:
                base_at.append(o)
                base_labels.add(label)
            elif cover < COVER:
                continue
            labels.add(label)
            found.append((label, o, len(template), cover))
            score = max(score, min(1.0, cover) * (1 - 0.5 ** len(hit)))
        return n, sorted(base_at), base_labels, labels, score, found

    @property
    def looked_up(self) -> set[bytes]:
        if "_looked_up" not in self.__dict__:
            self._looked_up = {*self.postings} | {w for t in self.templates for w, _ in t[5]}
        return self._looked_up


def corpus_index(docs: DataFrame, text_col: str, base: dict[str, str], notices) -> Index:
    """The index with IDF over all rows of ``docs``."""
    vocabulary = Index(base, notices).vocabulary

    def count(batches):
        got: dict[bytes, int] = {}
        for batch in slices(batches):
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                got[b""] = got.get(b"", 0) + 1
                for w in vocabulary.intersection((text or b"").translate(_WORDS).split()):
                    got[w] = got.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], ["word", "rows"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, rows long").groupBy("word").agg(F.sum("rows").alias("rows"))
    found = {bytes(r.word): r.rows for r in counts.collect()}  # at most one row a word of the templates
    return Index(base, notices, found, found.pop(b"", 0))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices=None, keep_matches: bool = False) -> DataFrame:
    """One row per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score [, matches]."""
    small_batches(docs.sparkSession)
    index = corpus_index(docs, text_col, BASE if base is None else base, NOTICES if notices is None else notices)

    def run(batches):
        for batch in slices(batches):
            rows = [index.scan((t.as_py() or "").encode()) for t in batch.column("text")]
            match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("cover", pa.float64())]))
            columns = [
                batch.column("id"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([r[1][0] if r[1] else None for r in rows], pa.int64()),
                pa.array([r[1][-1] if r[1] else None for r in rows], pa.int64()),
                pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                pa.array([r[4] for r in rows], pa.float64()),
                pa.array([[dict(zip(("label", "first_word", "words", "cover"), m)) for m in r[5]] if keep_matches else None for r in rows], match),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,words:long,cover:double>>"
    out = source.mapInArrow(run, schema)
    return (out if keep_matches else out.drop("matches")).withColumnRenamed("id", id_col)
