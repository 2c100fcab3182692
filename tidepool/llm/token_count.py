"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch become one
ragged numpy array of symbols, and every round applies each sequence's
lowest-ranked pair at all its places, all sequences at once, until no pair
has a rank. The symbols that survive are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import (CodeBook, lean_task, per_process, piece_batches, shared_file,
                                 sums_by_length, texts_in)

# Fixed value: the byte-level pre-token pattern of the vocabulary's family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: printable Latin-1 characters stand for themselves, the other
    bytes take the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeTable:
    """Byte-level BPE merges of a ``tokenizers`` JSON file as numpy arrays."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and spec["normalizer"] is None
                 and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "ignore_merges")))
        if not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.product = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len)[::-1]))) \
            if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word (at least one byte each)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), NO_RANK)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.concatenate([first, [len(sym)]]))
            low = np.minimum.reduceat(rank, first)
            done = low == NO_RANK
            out[owner[first[done]]] = size[done]
            go = np.repeat(~done, size)
            if not go.all():
                sym, owner, rank = sym[go], owner[go], rank[go]
                low, size = low[~done], size[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            # equal pairs that overlap (a run of one symbol) merge from the left:
            # of consecutive hits the first, third, ... count
            idx = np.arange(1, len(sym) + 1)
            last_miss = np.maximum.accumulate(np.where(hit, 0, idx))
            at = np.flatnonzero(hit & ((idx - last_miss) % 2 == 1))
            sym[at] = self.product[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[touched] = NO_RANK
            near = touched[touched + 1 < len(sym)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.rank(sym[near], sym[near + 1])
        return out


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text") -> Column:
    """``n_tokens`` (BIGINT) of ``text`` under the byte-level BPE JSON file
    ``tokenizer``, as a column of ``df``.

    Null and empty texts have 0 tokens. The strings of added tokens inside a
    text count one token each, as the library's default has them. Every text
    is counted whole: a very long one passes through in chunks of pre-tokens.
    Repeated rows are counted alike; all other columns of ``df`` stay."""
    data, key = shared_file(df.sparkSession, tokenizer)

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("token-count"):
            table = per_process(("merge-table", key), lambda: MergeTable(data.value))
            pattern = per_process("byte-level-pattern", lambda: regex.compile(PATTERN))

            def encode(new: list, results):
                counts = table.count([p.encode("utf-8", "surrogatepass") for p in new])
                return counts if results is None else np.concatenate([results, counts])

            book = per_process(("token-count", key), lambda: CodeBook(encode))
            for batch in batches:
                total = np.zeros(len(batch), dtype=np.int64)

                def segments():
                    for i, t in texts_in(batch):
                        if not t:
                            continue
                        if table.special is not None and table.special.search(t):
                            parts = table.special.split(t)
                            total[i] += len(parts) - 1
                            yield from ((i, p) for p in parts if p)
                        else:
                            yield i, t

                for pieces, owners, lengths in piece_batches(segments(), pattern.findall,
                                                             pattern.finditer):
                    if pieces:
                        rows = book.rows_of(pieces)
                        np.add.at(total, owners, sums_by_length(book.results[rows], lengths))
                yield pa.array(total)

    return counted.asNondeterministic()(F.col(text))


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024,
                 keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (n_tokens > limit) of each row's whole text. One scan, no
    shuffle. Columns of ``df`` that clash with the results are not read."""
    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")
    out = df.select(*keep, n_bytes.alias("n_bytes"),
                    count_tokens(df, tokenizer, text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
