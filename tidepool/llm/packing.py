"""Packing of tokenized documents into fixed-length sequences.

Documents are cut into full blocks and a remainder while they are tokenized;
remainders are packed first-fit decreasing, with a tournament tree over the
free room of the bins, independently in randomised groups of pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import (CodeBook, array_slices, lean_task, per_process, release_memory,
                                 shared_file, split_words, written)

PIECES = ("struct<doc_tokens:bigint,"
          "pieces:array<struct<start:bigint,length:bigint,ids_crc32:bigint>>>")
# Stands between words when many are encoded together; a word that holds it
# is encoded alone.
_BETWEEN = "\x01"
# Words in one text for the library; distinct words a process remembers;
# bytes of text in hand.
GROUP_WORDS, KNOWN_WORDS, PACK_SLICE_BYTES = 512, 400_000, 4 << 20
# Pieces of a packing group, on average: one group is packed in one task.
GROUP_PIECES = 6_000


# The text steps of the vocabularies whose plain words can take the
# short way below.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
          "use_regex": False}
# Plain words: Latin-1 letters, then some punctuation. Normalising is lower case,
# and the pattern cuts between the two parts.
_LETTERS, _PUNCT = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", "[.,;:!?*%$&#|]+"


class WordEncoder:
    """Ids of white-space separated words by a ``tokenizers`` JSON file whose
    normaliser and pre-tokenizer never look across white space.

    Words are encoded many at a time: with a separator token between them, or,
    where the vocabulary's text steps are the known ones, plain words by the
    library without those steps, which do nothing to them but lower case and
    one cut; the word-end mark tells where a word's ids end."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(data)
        (between,) = self._ids(self.tokenizer, [f" {_BETWEEN} "])
        if len(between) != 1:
            raise ValueError("the vocabulary has no token of its own for U+0001")
        self.between = between[0]
        self.plain = None
        spec = json.loads(data)
        pre = spec["pre_tokenizer"] or {}
        split, bytes_ = (pre.get("pretokenizers") or [{}, {}])[:2]
        if (spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS}
                and split.get("pattern") == {"Regex": _SPLIT} and split.get("invert")
                and split.get("behavior") == "Removed" and bytes_ == _BYTES
                and len(pre["pretokenizers"]) == 2
                and spec["model"].get("end_of_word_suffix") == "</w>"):
            ends = [i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
            self.ends[ends] = True
            self.plain = Tokenizer.from_str(json.dumps(spec | {
                "normalizer": None, "added_tokens": [], "pre_tokenizer": {
                    "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}}))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: the ids of all words one after the other, and how
        many each word has."""
        array = pa.array(words, type=pa.string())
        plain = pc.match_substring_regex(array, f"^{_LETTERS}({_PUNCT})?$") if self.plain \
            else pa.array(np.zeros(len(words), dtype=bool))
        plain = plain.to_numpy(zero_copy_only=False)
        alone = pc.match_substring(array, _BETWEEN).to_numpy(zero_copy_only=False)
        ids, sizes, place = [], [], []
        for mask, way in ((plain, self._plain), (alone, self._alone),
                          (~plain & ~alone, self._separated)):
            if mask.any():
                x, n = way(array.filter(pa.array(mask)))
                ids.append(x)
                sizes.append(n)
                place.append(np.flatnonzero(mask))
        if not place:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        if len(ids) == 1:
            return flat, size
        # back to the order of the words
        order = np.argsort(np.concatenate(place))
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        return flat[shift + np.arange(len(flat))], size

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        two = pc.match_substring_regex(words, f"{_PUNCT}$").to_numpy(zero_copy_only=False)
        parts = pc.replace_substring_regex(words, f"^({_LETTERS})({_PUNCT})$",
                                           r"\1 \2").to_pylist()
        texts = [" ".join(parts[lo:lo + GROUP_WORDS]).lower()
                 for lo in range(0, len(parts), GROUP_WORDS)]
        flat = np.concatenate([np.array(x, dtype=np.uint32)
                               for t in texts for x in self._ids(self.plain, [t])])
        last = np.flatnonzero(self.ends[flat])
        upto = np.cumsum(1 + two)
        if upto[-1] != len(last):
            raise ValueError("a plain word was cut otherwise")
        return flat, np.diff(np.concatenate([[-1], last[upto - 1]]))

    def _separated(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, ids, sizes = array.to_pylist(), [], []
        for lo in range(0, len(words), GROUP_WORDS):
            members = words[lo:lo + GROUP_WORDS]
            (found,) = self._ids(self.tokenizer, [f" {_BETWEEN} ".join(members)])
            flat = np.array(found, dtype=np.uint32)
            mark = flat == self.between
            cuts = np.flatnonzero(mark)
            if len(cuts) != len(members) - 1:
                raise ValueError("a word changed the separator")
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(flat)]])) - 1)
            ids.append(flat[~mark])
        return np.concatenate(ids), np.concatenate(sizes)

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x, dtype=np.uint32) for x in self._ids(self.tokenizer, words.to_pylist())]
        return np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64)


class WordIds:
    """Ids of the words known so far, in arrays that grow by doubling."""

    def __init__(self):
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.words = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> "WordIds":
        used = int(self.ends[self.words])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used:used + len(ids)] = ids
        self.ends[self.words + 1:self.words + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.words += len(sizes)
        return self


def cut_texts(df: DataFrame, tokenizer: str, text: str = "text", length: int = 2048,
              end_id: int = 1, known_words: int = KNOWN_WORDS,
              slice_bytes: int = PACK_SLICE_BYTES) -> Column:
    """A struct column: ``doc_tokens`` and ``pieces`` of every whole text, as
    ids of ``tokenizer`` without added special tokens, then ``end_id``; pieces
    of ``length`` ids and a remainder. Null and empty texts: ``end_id`` only.

    White space separates pre-tokens in the vocabularies this serves (their
    normaliser folds it and their pattern drops it), so distinct words are
    encoded once and their ids put together. A process remembers
    ``known_words`` of them and has ``slice_bytes`` of text in hand: smaller
    numbers save memory for time, the result is the same."""
    data, key = shared_file(df.sparkSession, tokenizer)

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("packing"):
            encoder = per_process(("word-encoder", key), lambda: WordEncoder(data.value))

            def encode(new: list, results: WordIds | None) -> WordIds:
                return (results or WordIds()).add(*encoder.encode(
                    [w.decode("utf-8", "surrogatepass") for w in new]))

            book = per_process(("word-ids", key, known_words),
                               lambda: CodeBook(encode, known_words))
            for batch in batches:
                tokens: list[int] = []
                starts: list[np.ndarray] = []
                sizes: list[np.ndarray] = []
                sums: list[int] = []
                for _, part in array_slices(batch, slice_bytes):
                    words, counts = split_words(part)
                    rows = book.rows_of_array(words)
                    known = book.results or WordIds()
                    flat, ends = known.flat, known.ends
                    size = ends[rows + 1] - ends[rows]
                    upto = np.concatenate([[0], np.cumsum(size)])
                    # the ids of all words of the slice, one after the other
                    at = np.repeat(ends[rows] - upto[:-1], size) + np.arange(upto[-1])
                    ids = flat[at]
                    cut_at = upto[np.concatenate([[0], np.cumsum(counts)])]
                    for lo, hi in zip(cut_at[:-1], cut_at[1:]):
                        own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                        start = np.arange(0, len(own), length)
                        tokens.append(len(own))
                        starts.append(start)
                        sizes.append(np.minimum(length, len(own) - start))
                        sums += [zlib.crc32(own[s:s + length].tobytes()) for s in start]
                    del words, rows, size, upto, at, ids
                    if slice_bytes < PACK_SLICE_BYTES:
                        release_memory()
                none = np.zeros(0, np.int64)
                pieces = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([none, *starts])),
                     pa.array(np.concatenate([none, *sizes])), pa.array(sums, type=pa.int64())],
                    names=["start", "length", "ids_crc32"])
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
                yield pa.StructArray.from_arrays(
                    [pa.array(tokens, type=pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pieces)],
                    names=["doc_tokens", "pieces"])

    return cut.asNondeterministic()(F.col(text))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of every item: items by falling length (ties in the
    given order), each into the first bin with room, found by walking down a
    tournament tree whose nodes hold the most room below them."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    sizes = lengths.tolist()
    for i in order.tolist():
        need = sizes[i]
        if need > capacity:
            raise ValueError("an item is longer than a bin")
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pack(pieces: DataFrame, length: str = "length", capacity: int = 2048,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``capacity``: rows of a sequence lie side by side from offset 0 and sum
    to at most ``capacity``.

    Rows are dealt by a hash of the row and its place into groups of about
    ``group_pieces`` (as many groups as a count of the rows calls for), so no
    source, document or set of copies gathers in one; each group is packed
    first-fit decreasing in one task. ``sequence_id`` is group * 2^32 + bin. The
    rows are written once before they are counted and dealt. Existing columns
    named ``sequence_id`` or ``offset`` are replaced; an empty table gives an
    empty table; a null length or one out of range fails the job."""
    rows = written(pieces.drop("sequence_id", "offset"), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(*rows.columns, place),
                                             F.lit(groups)).cast("bigint"))
    schema = rows.schema.simpleString()[len("struct<"):-1]

    def pack_group(table: pa.Table) -> pa.Table:
        lengths = table[length].to_numpy()
        if not (np.all(lengths >= 1) and np.all(lengths <= capacity)):
            raise ValueError("length out of range")
        group = table["_group"][0].as_py() if table.num_rows else 0
        bins, offsets = first_fit_decreasing(lengths, capacity)
        return (table.drop_columns(["_group"])
                .append_column("sequence_id", pa.array((group << 32) + bins))
                .append_column("offset", pa.array(offsets)))

    return dealt.groupBy("_group").applyInArrow(
        pack_group, f"{schema},sequence_id:bigint,offset:bigint")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = 2048, end_id: int = 1, known_words: int = KNOWN_WORDS,
                   slice_bytes: int = PACK_SLICE_BYTES) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``. Rows with equal or null
    ``doc_id`` are documents of their own; other columns are not read. For
    ``known_words`` and ``slice_bytes`` see :func:`cut_texts`."""
    cut = docs.select(F.col(doc_id).alias("doc_id"),
                      cut_texts(docs, tokenizer, text, capacity, end_id, known_words,
                                slice_bytes).alias("_cut"))
    pieces = cut.select("doc_id", F.col("_cut.doc_tokens").alias("doc_tokens"),
                        F.inline("_cut.pieces"))
    return pack(pieces, "length", capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
