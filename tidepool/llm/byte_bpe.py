"""Byte-level BPE encoding in linear time, and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton
over the vocabulary (pyahocorasick) finds the longest token at every place.
Tokens next to each other in a BPE encoding are exactly those whose joined
bytes encode to the same two tokens; this test is memoised per pair. A
piece's encoding is found from the longest matches: as long as neighbours
are compatible the longest match stands, otherwise the search backs up to a
shorter one. A prefix of a piece has only one valid encoding, so a position
that once led nowhere is never tried again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import (CodeBook, lean_task, per_process, piece_batches, shared_file,
                                 sums_by_length, texts_in)

# Stands between pieces in one pass of the automaton: no byte maps to it.
_BETWEEN = "Ā"
# Distinct token pairs (and choices after a token) remembered by a process.
MAX_PAIRS = 1_000_000

RESULT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


# Rank that stands for the beginning of a piece in a pair; above any vocabulary.
_BEGIN = 1 << 24


class Vocabulary:
    """Token ranks of a ``.tiktoken`` file, its automaton and pair memo."""

    def __init__(self, data: bytes):
        self.rank: dict[str, int] = {}
        for line in data.splitlines():
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.text = {r: t for t, r in self.rank.items()}
        self.token = {r: t.encode("latin-1") for t, r in self.rank.items()}
        self.size = {r: len(t) for r, t in self.text.items()}
        self.most = max(self.size.values(), default=0)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.choices: dict[int, int] = {}
        self.prefix: dict[int, int] = {}

    def merged(self, piece: str) -> list[str]:
        """The merges by their definition: join the leftmost lowest-ranked
        pair until none has a rank. For the short strings of the pair test."""
        parts = list(piece)
        rank = self.rank
        while len(parts) > 1:
            scores = [rank.get(a + b, _BEGIN) for a, b in zip(parts, parts[1:])]
            best = min(scores)
            if best == _BEGIN:
                break
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (``_BEGIN``: begin a piece),
        remembered per pair."""
        key = before << 25 | token
        known = self.pairs.get(key)
        if known is None:
            text = self.text[token]
            last = [] if before == _BEGIN else [self.text[before]]
            known = self.merged("".join([*last, text])) == [*last, text]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def longest(self, piece: str, at: int) -> int:
        """The longest token that begins at ``at``: the automaton tells how far
        the text follows any token, the rank table where one ends."""
        rest = piece[at:at + self.most]
        size = self.automaton.longest_prefix(rest)
        rank = self.rank
        while size:
            token = rank.get(rest[:size])
            if token is not None:
                return token
            size -= 1
        raise ValueError("the vocabulary lacks a byte of the text")

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        known = self.prefix.get(token)
        if known is None:
            text = self.text[token]
            known = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1)
                          if text[:n] in self.rank), -1)
            self.prefix[token] = known
        return known

    def choice(self, before: int, token: int) -> int:
        """The longest of ``token`` and its shorter prefixes that fits after
        ``before``, or -1; remembered per pair."""
        key, pick = before << 25 | token, token
        while pick >= 0 and not self.fits(before, pick):
            pick = self.shorter(pick)
        if len(self.choices) >= MAX_PAIRS:
            self.choices.clear()
        self.choices[key] = pick
        return pick

    def backtracked(self, piece: str, matches: list[int] | None = None) -> list[int]:
        """The token ids of one piece (Latin-1 characters). ``matches`` are its
        longest matches from the left, if they are known: they stand as long
        as each fits its neighbour."""
        n = len(piece)
        choices, size = self.choices, self.size
        tokens: list[int] = []
        dead: set[int] = set()
        at, before = 0, _BEGIN
        aligned = bool(matches)
        token = matches[0] if aligned else self.longest(piece, 0)
        while True:
            pick = -1
            if token >= 0:
                pick = choices.get(before << 25 | token)
                if pick is None:
                    pick = self.choice(before, token)
                while dead and pick >= 0 and at + size[pick] in dead:
                    shorter = self.shorter(pick)
                    pick = self.choice(before, shorter) if shorter >= 0 else -1
            if pick >= 0:
                tokens.append(pick)
                before = pick
                at += size[pick]
                if at == n:
                    return tokens
                aligned = aligned and pick == token
                token = matches[len(tokens)] if aligned else self.longest(piece, at)
            elif tokens:
                dead.add(at)
                last = tokens.pop()
                at -= size[last]
                before = tokens[-1] if tokens else _BEGIN
                token, aligned = self.shorter(last), False
            else:
                raise ValueError("no encoding of the piece is stable")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of every piece. A piece that is a token is that token;
        for the others one pass of the automaton over all pieces gives the
        longest matches from the left, and a piece is searched on from the
        first place where two neighbours do not fit."""
        out: list = [None] * len(pieces)
        rest = []
        for i, r in enumerate(map(self.rank.get, pieces)):
            if r is None:
                rest.append(i)
            else:
                out[i] = [r]
        if not rest:
            return out
        joined = _BETWEEN.join([pieces[i] for i in rest])
        matches = self.automaton.iter_long(joined)
        todo = iter(rest)
        i, found = next(todo), []
        stop = len(pieces[i])
        for end, token in matches:
            while end > stop:
                out[i] = self.backtracked(pieces[i], found)
                i, found = next(todo), []
                stop += len(pieces[i]) + 1
            found.append(token)
        out[i] = self.backtracked(pieces[i], found)
        for i in todo:
            out[i] = self.backtracked(pieces[i])
        return out

    def decode(self, ids) -> bytes:
        """The bytes of token ids."""
        return b"".join(map(self.token.__getitem__, ids))


def _as_latin1(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def encode_texts(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> Column:
    """A struct column of ``df``: ``n_tokens`` (BIGINT), ``ids_sha256`` (hex
    digest of the decimal ids joined by commas) and ``decoded_sha256`` (hex
    digest of the bytes decoded from the ids) of every whole text.

    ``ranks`` is a ``.tiktoken`` file; each match of ``pattern`` is encoded
    separately; special strings are ordinary text. Null and empty texts have
    no tokens (digests of nothing). Very long texts pass through in chunks of
    pieces. Repeated rows give equal rows."""
    data, key = shared_file(df.sparkSession, ranks)

    @F.arrow_udf(RESULT)
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("byte-bpe"):
            vocab = per_process(("vocabulary", key), lambda: Vocabulary(data.value))
            rx = per_process(("pattern", pattern), lambda: regex.compile(pattern))

            def encode(new: list, results):
                counts, written, decoded = results or (np.zeros(0, np.int64), [], [])
                ids = vocab.encode([_as_latin1(p) for p in new])
                written.extend(",".join(map(str, x)) for x in ids)
                decoded.extend(map(vocab.decode, ids))
                return np.concatenate([counts, np.fromiter(map(len, ids), np.int64)]), written, decoded

            book = per_process(("byte-bpe", key, pattern), lambda: CodeBook(encode, 450_000))
            for batch in batches:
                n = len(batch)
                total = np.zeros(n, dtype=np.int64)
                ids_sha = [hashlib.sha256() for _ in range(n)]
                bytes_sha = [hashlib.sha256() for _ in range(n)]
                begun = bytearray(n)
                segments = ((i, t) for i, t in texts_in(batch) if t)
                for pieces, owners, lengths in piece_batches(segments, rx.findall,
                                                             lambda t: rx.finditer(t)):
                    if not pieces:
                        continue
                    rows = book.rows_of(pieces)
                    counts, ids_text, decoded = book.results
                    np.add.at(total, owners, sums_by_length(counts[rows], lengths))
                    rows = rows.tolist()
                    at = 0
                    for i, length in zip(owners, lengths):
                        own = rows[at:at + length]
                        at += length
                        if own:
                            joined = ",".join([ids_text[r] for r in own])
                            ids_sha[i].update((("," if begun[i] else "") + joined).encode())
                            bytes_sha[i].update(b"".join([decoded[r] for r in own]))
                            begun[i] = 1
                yield pa.StructArray.from_arrays(
                    [pa.array(total), pa.array([h.hexdigest() for h in ids_sha]),
                     pa.array([h.hexdigest() for h in bytes_sha])],
                    names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.asNondeterministic()(F.col(text))


def encode_ids(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> Column:
    """The token ids themselves (``array<int>``) of every text; null: none."""
    data, key = shared_file(df.sparkSession, ranks)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("byte-bpe"):
            vocab = per_process(("vocabulary", key), lambda: Vocabulary(data.value))
            rx = per_process(("pattern", pattern), lambda: regex.compile(pattern))
            for batch in batches:
                total, found = np.zeros(len(batch), dtype=np.int64), [np.zeros(0, np.int32)]
                segments = ((i, t) for i, t in texts_in(batch) if t)
                for pieces, owners, lengths in piece_batches(segments, rx.findall,
                                                             lambda t: rx.finditer(t)):
                    if not pieces:
                        continue
                    ids = vocab.encode([_as_latin1(p) for p in pieces])
                    counts = np.fromiter(map(len, ids), np.int64, len(ids))
                    np.add.at(total, owners, sums_by_length(counts, lengths))
                    found.append(np.fromiter(chain.from_iterable(ids), np.int32, counts.sum()))
                ends = np.concatenate([[0], np.cumsum(total)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))

    return ids_of.asNondeterministic()(F.col(text))


def decode_ids(df: DataFrame, ranks: str, ids: str = "ids") -> Column:
    """The bytes (BINARY) of an ``array<int>`` column of token ids; a null
    array gives null, an id outside the vocabulary fails the job."""
    data, key = shared_file(df.sparkSession, ranks)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("byte-bpe"):
            vocab = per_process(("vocabulary", key), lambda: Vocabulary(data.value))
            for batch in batches:  # row by row: the ids of one are Python objects at a time
                yield pa.array([vocab.decode(x.as_py()) if x.is_valid else None for x in batch],
                               type=pa.binary())

    return bytes_of.asNondeterministic()(F.col(ids))


def byte_bpe(df: DataFrame, ranks: str, pattern: str, text: str = "text",
             keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``
    of each row's whole text (see :func:`encode_texts`). One scan, no shuffle."""
    return df.select(*keep, encode_texts(df, ranks, pattern, text).alias("_bpe")).select(
        *keep, "_bpe.n_tokens", "_bpe.ids_sha256", "_bpe.decoded_sha256")
