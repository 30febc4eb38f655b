"""Operator 3: byte-level BPE encoding and decoding.

The encoder finds, in each piece that the tokenizer's pattern cuts, the longest
vocabulary entry at every byte by one Aho-Corasick pass, then walks left to right:
it takes the longest entry, keeps it if the pair with the token before it is one
that merging in rank order would leave side by side, and else takes the next
shorter entry or backtracks.  Every byte is tried a bounded number of times, so
the time is linear and the tokens are those of the merge procedure.

The pair table is a memo: whether two tokens may stand together follows from
undoing their merges, and is worked out at the first question.

Decoding gathers bytes by an offset table over one buffer of all entries.

Pieces repeat, so a worker memoises those of fewer than ``SHORT`` characters, up to
``MEMO`` pieces, and starts anew beyond; the memo never changes a result.

Defined results: null text counts as empty, which gives no tokens; rows are
independent, so repeated rows and null ids give equal, separate rows; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Fixed value: the pattern of byte-level BPE that cuts text into pieces, the commonest kind first.
PATTERN = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 300_000
SHORT = 64
#: Pairs of tokens that a worker remembers.
PAIRS = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ids = vocab
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for b, i in vocab.items():
            self.token[i] = b
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.rank, self.split = {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[to_bytes(s)] for s in (merge.split(" ") if isinstance(merge, str) else merge))
            made = vocab[self.token[left] + self.token[right]]
            if (left, right) not in self.rank:
                self.rank[left, right] = (rank, made)
            self.split.setdefault(made, (rank, left, right))
        # entries that no merge makes are never produced, single bytes aside
        usable = {b: i for b, i in vocab.items() if len(b) == 1 or i in self.split}
        self.machine = ahocorasick.Automaton()
        for b, i in usable.items():
            self.machine.add_word(b.decode("latin-1"), (len(b), i))
        self.machine.make_automaton()
        #: The longest usable entry that is a proper prefix of an entry.
        self.shorter = {}
        for b, i in usable.items():
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in usable:
                    self.shorter[i] = usable[b[:n]]
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | None] = {}
        self.cut = regex.compile(PATTERN)
        self.mark = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        sizes = np.array([len(b) for b in self.token], np.int64)
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.buffer = np.frombuffer(b"".join(self.token), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges from the later to the earlier; at each step the inner edge
        # pair must not be one that would have merged before the undone merge.
        limit, a, b = 1 << 60, left, right
        while True:
            made = self.rank.get((a, b))
            if made is not None and made[0] < limit:
                return False
            sa, sb = self.split.get(a), self.split.get(b)
            ra, rb = sa[0] if sa else -1, sb[0] if sb else -1
            if ra < 0 and rb < 0:
                return True
            # The later merge is undone.  Of equal merges the leftmost comes first, so
            # the edge pair wins a tie against the right token's merge, not the left's.
            if ra > rb:
                limit, a = ra, sa[2]
            else:
                limit, b = rb + 1, sb[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None and (len(piece) == 1 or whole in self.split) and self._whole(piece, whole):
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (size, token) in self.machine.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, entry, shorter = 0, longest[0], self.token, self.shorter
        while at < n:
            size = len(entry[token])
            if open_at[at + size] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at += size
                if at < n:
                    token = longest[at]
            elif token in shorter:
                token = shorter[token]
            else:
                open_at[at] = 0
                if not out:
                    raise ValueError("a byte has no entry")
                token = out.pop()
                at -= len(entry[token])
        return out

    @lru_cache(maxsize=65536)
    def _whole(self, piece: bytes, token: int) -> bool:
        """Whether merging makes the entry from its own bytes."""
        if len(piece) == 1:
            return True
        _, left, right = self.split[token]
        return self._whole(self.token[left], left) and self._whole(self.token[right], right) and self.compatible_below(left, right, self.split[token][0])

    def compatible_below(self, left: int, right: int, rank: int) -> bool:
        """Whether the inner edges of the two parts of a merge survive until that merge."""
        made = self.rank.pop((left, right), None)
        try:
            return self._compatible(left, right)
        finally:
            if made is not None:
                self.rank[left, right] = made

    def _pieces(self, text: str) -> bytes:
        """Ids of a text without special tokens, cut by the pattern."""
        memo, out = self.memo, []
        for piece in self.cut.findall(text):
            got = memo.get(piece)
            if got is None:
                got = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(memo) >= MEMO:
                    memo.clear()
                if len(piece) < SHORT:
                    memo[piece] = got
            out.append(got)
        return b"".join(out)

    def _spaced(self, text: str) -> bytes:
        """As ``_pieces``, by stretches between single spaces.

        A space between two other characters that are no white space always
        starts a piece, so what follows it can be encoded alone and memoised.
        """
        first, *rest = text.split(" ")
        if not rest:
            return self._pieces(text)
        memo, long = self.spaced, {}
        new = [c for c in {*rest} if c not in memo]
        if len(memo) + len(new) > 2 * MEMO:
            memo.clear()
            new = list({*rest})
        for c in new:
            # with white space at an end, the pattern looks beyond the stretch
            (memo if len(c) < SHORT else long)[c] = None if not c or c[0].isspace() or c[-1].isspace() else self._pieces(" " + c)
        got = [long[c] if c in long else memo[c] for c in rest] if long else [memo[c] for c in rest]
        if None not in got and first and not first[-1].isspace():
            return self._pieces(first) + b"".join(got)
        out, held = [], first
        for k, c in enumerate(rest):
            if got[k] is None or not held or held[-1].isspace():
                held += " " + c
            else:
                out.append(self._pieces(held))
                held = " " + c
        return b"".join([*out, self._pieces(held)])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, special tokens' strings as their ids."""
        if self.mark is None or not any(s in text for s in self.special):
            return np.frombuffer(self._spaced(text), "<u4")
        out = []
        for part in self.mark.split(text):
            out.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._spaced(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        start, size = self.start[ids], self.stop[ids] - self.start[ids]
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.buffer[place].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 [, ids].

    ``tokenizer`` is the path of a byte-level BPE file in the tokenizers format
    that every executor can read.
    """

    def run(batches):
        from tallyrill.llm.byte_bpe import codec

        c = codec(tokenizer)
        for batch in slices(batches):
            ids = batch.column("id")
            texts = batch.column("text").to_pylist()
            rows = [c.encode(t or "") for t in texts]
            columns = [ids, pa.array([len(r) for r in rows], pa.int64())]
            columns.append(pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string()))
            columns.append(pa.array([hashlib.sha256(c.decode(r).encode()).hexdigest() for r in rows], pa.string()))
            columns.append(pa.array([r.astype(np.int64).tolist() for r in rows] if keep_ids else [None] * len(rows), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>")
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("id", id_col)
