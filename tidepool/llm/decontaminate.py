"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items go into one suffix automaton over their words. The
words of a document are streamed through it: every step keeps the longest run
of words, ending here, that occurs in some item. Where that run reaches the
window length, the window's words are hit, and the state of the window tells
which items have it. Items shorter than the window match as a whole. Spans of
hit words are removed if they are long enough, and documents of which too
much is hit are dropped.

A word that no item has, or a pair of words that no item has in a row, ends
every match, so only the stretches in between that are long enough for a
window pass through the automaton word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import (array_slices, dropped, lean_task, texts_in, written)
from tidepool.llm.importance import _word_table

WINDOW = 10
# Words of the items of one automaton (about 80 MB); more items take several
# passes over the documents.
AUTOMATON_WORDS = 200_000

HITS = ("struct<n_words:bigint,n_hit:bigint,longest:bigint,"
        "spans:array<struct<first:int,end:int>>,items:array<bigint>>")


class ItemAutomaton:
    """Suffix automaton of word sequences ``(item id, word ids)``."""

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        words = sorted({w for _, own in items for w in own})
        self.words = pa.array(words, type=pa.large_binary())
        code = {w: i for i, w in enumerate(words)}
        coded = [(item, [code[w] for w in own]) for item, own in items if own]
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        pairs = set()
        for _, own in coded:
            state = 0
            for c in own:
                state = self._extended(state, c)
            pairs.update(zip(own, own[1:]))
        self.pairs = np.sort(np.array([a * len(words) + b for a, b in pairs], dtype=np.int64))
        # the shortest run of words that can hold a window
        self.shortest = min([window, *[len(own) for _, own in coded]])
        self._windows(coded)

    def _extended(self, last: int, c: int) -> int:
        """The state of the sequence that led to ``last`` and then ``c``."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of state ``q`` no longer than ``p`` and ``c``, as a state of
        its own."""
        part = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[part], self.link[q] = self.link[q], part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _windows(self, coded: list[tuple]) -> None:
        """``held[state]``: the items of a window state; ``at_window[state]``:
        the state of the last ``window`` words of its runs; ``whole[state]``:
        the nearest state, this or up the links, that is a whole short item."""
        n = len(self.next)
        self.at_window, self.whole = [-1] * n, [-1] * n
        short: dict[int, set] = {}
        for item, own in coded:
            if len(own) < self.window:
                state = 0
                for c in own:
                    state = self.next[state][c]
                short.setdefault(state, set()).add(item)
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.whole[v] = v if v in short else self.whole[up] if up >= 0 else -1
            if self.length[v] >= self.window:
                self.at_window[v] = v if self.length[up] < self.window else self.at_window[up]
        held = dict(short)
        for item, own in coded:
            state = 0
            for place, c in enumerate(own):
                state = self.next[state][c]
                if place + 1 >= self.window:
                    held.setdefault(self.at_window[state], set()).add(item)
        self.held = {v: frozenset(s) for v, s in held.items()}

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """``(place, hit words up to it, longest match)`` wherever a window
        ends, and adds its state to ``seen``."""
        state = length = 0
        nxt, link, lengths = self.next, self.link, self.length
        window, whole, at_window, seen = self.window, self.whole, self.at_window, self.seen
        for place, c in enumerate(codes):
            while state and c not in nxt[state]:
                state = link[state]
                length = lengths[state]
            state = nxt[state].get(c, 0)
            length = length + 1 if state else 0
            hit = 0
            if length >= window:
                seen.add(at_window[state])
                hit = window
            # the state's own longest run only counts if the match is that long
            v = state if not state or lengths[state] <= length else link[state]
            v = whole[v] if v >= 0 else -1
            while v >= 0:
                seen.add(v)
                hit = max(hit, lengths[v])
                v = whole[link[v]]
            if hit:
                yield place, hit, length

    def matches(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """``(text, hit, longest, states)`` of the texts that hold windows:
        ``codes`` are the words of several texts (-1: of no item), text i ends
        before ``ends[i]``; ``hit`` are the places of the text's words."""
        known = codes >= 0
        joined = np.zeros(len(codes) + 1, dtype=bool)  # word i goes on from word i - 1
        if len(codes) > 1 and len(self.pairs):
            pair = codes[:-1] * len(self.words) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:-1] = known[:-1] & known[1:] & (self.pairs[at] == pair)
        joined[np.minimum(ends, len(codes))] = False
        first = np.flatnonzero(known & ~joined[:-1])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        enough = last - first >= self.shortest
        first, last = first[enough], last[enough]
        owner = np.searchsorted(ends, first, side="right")
        begin = np.concatenate([[0], ends[:-1]])
        at = 0
        while at < len(first):
            text = owner[at]
            hit, longest, self.seen = set(), 0, set()
            while at < len(first) and owner[at] == text:
                base = int(first[at] - begin[text])
                for place, n, length in self.stream(codes[first[at]:last[at]].tolist()):
                    hit.update(range(base + place + 1 - n, base + place + 1))
                    longest = max(longest, length)
                at += 1
            if hit:
                yield int(text), np.array(sorted(hit)), longest, self.seen


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(hit) > 1)
    first, end = np.append(hit[0], hit[edge + 1]), np.append(hit[edge], hit[-1]) + 1
    return [{"first": int(a), "end": int(b)} for a, b in zip(first, end)]


def split_lowered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (lower-cased) as one binary array, and where
    each text's words end in it."""
    lowered = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    if not len(lowered):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    _, offsets, data = lowered.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lowered.offset:lowered.offset + len(lowered) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    clean = np.frombuffer(_word_table(), np.uint8)[raw]
    inside = clean != 0x20
    filled = np.diff(offsets) > 0
    first_byte, last_byte = offsets[:-1][filled], offsets[1:][filled] - 1
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    starts[first_byte], stops[last_byte] = inside[first_byte], inside[last_byte]
    begin = np.flatnonzero(starts)
    length = np.flatnonzero(stops) + 1 - begin
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(length), [
        None, pa.py_buffer(at.tobytes()), pa.py_buffer(clean[inside].tobytes())])
    return words, np.searchsorted(begin, offsets[1:], side="left")


def _automata(items: DataFrame, window: int, item_id: str, text: str) -> Iterator[ItemAutomaton]:
    """Automata of a bounded number of words each. Items come to the driver
    group by group, dealt by a hash of their text."""
    own = items.select(F.col(item_id).cast("bigint").alias("item_id"),
                       F.col(text).cast("string").alias("text")).where(
        F.length("text") > 0).distinct()
    # a word has two bytes at least, its end included
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (2 * AUTOMATON_WORDS)))
    if n > 1:
        own = written(own, "test-items")
    for g in range(n):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == g).toArrow()
        texts = pa.concat_arrays(rows["text"].chunks or [pa.array([], pa.string())])
        found, ends = split_lowered(texts)
        found = found.to_pylist()
        first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        automaton = ItemAutomaton([(i, found[a:b]) for i, a, b in zip(
            rows["item_id"].to_pylist(), first.tolist(), ends.tolist())], window)
        if g == 0 or len(automaton.words):
            yield automaton
    if n > 1:
        dropped(own)


def _found(own: ItemAutomaton, texts: pa.Array, before: list | None) -> pa.Array:
    n = len(texts)
    n_words, n_hit, longest = np.zeros((3, n), dtype=np.int64)
    spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
    places: dict[int, np.ndarray] = {}
    for i, b in enumerate(before or []):
        if b["n_hit"]:
            places[i] = np.concatenate([np.arange(s["first"], s["end"]) for s in b["spans"]])
            longest[i], items[i] = b["longest"], set(b["items"])
    for first, part in array_slices(texts):
        words, ends = split_lowered(part)
        n_words[first:first + len(part)] = np.diff(ends, prepend=0)
        codes = pc.fill_null(pc.index_in(words, own.words), -1)
        codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
        for text, hit, most, states in own.matches(codes, ends):
            i = first + text
            places[i] = np.union1d(places[i], hit) if i in places else hit
            longest[i] = max(longest[i], most)
            items[i].update(x for s in states for x in own.held[s] if x is not None)
    for i, hit in places.items():
        n_hit[i], spans[i] = len(hit), _spans(hit)
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array(longest),
         pa.array(spans, pa.list_(span)),
         pa.array([sorted(i) for i in items], pa.list_(pa.int64()))],
        names=["n_words", "n_hit", "longest", "spans", "items"])


def with_hits(docs: DataFrame, items: DataFrame, out: str = "hits", window: int = WINDOW,
              text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``out``: ``n_words``, ``n_hit`` (words
    inside any occurrence of a window: ``window`` consecutive words of an item,
    or all of a shorter item), ``longest`` (the longest run of words that is
    in an item, where a window ends), ``spans`` of hit words and ``items``
    (distinct ids of the items with an occurring window, ascending).

    Words are runs of digits, a-z and non-ASCII characters after lower-casing
    A-Z. Null and empty texts have no words; items without words have no
    windows; an item without an id hits words but is not listed; items of one
    id count once. Repeated documents are judged alike. No items: nothing is
    hit. A column named ``out`` is replaced. One scan, no shuffle; every
    ``AUTOMATON_WORDS`` words of the items beyond the first take another pass
    over the documents, whose hits are written."""
    if window < 1:
        raise ValueError("a window has at least one word")
    found, before = docs, None
    for k, automaton in enumerate(_automata(items, window, item_id, item_text)):
        if k:
            found = written(found, "item-hits")
            if before is not None:
                dropped(before)
            before = found
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        found = found.withColumn(out, _hits(shared, F.col(text), F.col(out) if k else None))
    return found


def _hits(shared: Broadcast, text: Column, before: Column | None) -> Column:
    if before is None:
        @F.arrow_udf(HITS)
        def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with lean_task("decontaminate"):
                for batch in batches:
                    yield _found(shared.value, batch, None)

        return hits.asNondeterministic()(text.cast("string"))

    @F.arrow_udf(HITS)
    def more_hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with lean_task("decontaminate"):
            for texts, found in batches:
                yield _found(shared.value, texts, found.to_pylist())

    return more_hits.asNondeterministic()(text.cast("string"), before)


def without_spans(text: Column, spans: Column, min_span: int) -> Column:
    """Texts without the words of spans of at least ``min_span`` words, and
    what stands between these words (other texts: as they are)."""
    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with lean_task("decontaminate"):
            for texts, found in batches:
                yield pa.array([of_text(t, found[i].as_py()) for i, t in texts_in(texts)],
                               type=pa.string())

    table, word = _word_table(), re.compile(rb"[^ ]+")

    def of_text(t: str | None, found: list | None) -> str | None:
        gone = [s for s in found or [] if s["end"] - s["first"] >= min_span]
        if t is None or not gone:
            return t
        data = t.encode("utf-8", "surrogatepass")
        place = [m.span() for m in word.finditer(data.lower().translate(table))]
        kept, at = [], 0
        for s in gone:
            kept.append(data[at:place[s["first"]][0]])
            at = place[s["end"] - 1][1]
        return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")

    return cut.asNondeterministic()(text, spans)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  min_span: int | None = None, max_percent: int = 100, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without benchmark passages: hit spans of at least ``min_span``
    words (``window`` if not given) are cut out of ``text``, and documents
    with more than ``max_percent`` of their words hit are dropped. All other
    columns stay; see :func:`with_hits` for odd rows."""
    name = "_hits"
    while name in docs.columns:
        name += "_"
    found = with_hits(docs, items, name, window, text, item_id, item_text)
    hit = F.col(name)
    kept = found.where(F.lit(100) * hit["n_hit"] <= F.lit(max_percent) * hit["n_words"])
    clean = without_spans(F.col(text), hit["spans"], window if min_span is None else min_span)
    return kept.withColumn(text, clean).select(*docs.columns)
