"""Keyed stateful processors run for groups of keys at once.

A call of a Python stateful processor costs milliseconds: every state access
is a round trip to the state store, and every call sends its rows in a batch
of its own. With millions of keys that is most of the time. Here a key is
dealt to one of a fixed number of key groups by its hash; Spark groups,
shuffles and checkpoints by key group, and a call reads the states of the
group's keys at once, folds the new rows key by key with the processor of one
key, and writes the states back.

Spark hands rows to Python value by value, which costs more than folding them:
columns whose values JSON gives back unchanged travel as one text. Rows of
nothing else are bundled before they are shuffled: those of a key group that a
task has in hand are one compressed row.

What a key holds beyond ``LARGE_ROWS`` rows of a list, or of a map's value,
lies in state entries of its own that are read only when the processor asks
for them, so a hot key's waiting rows are not rewritten with its group.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GROUP, PACKED = "tp_key_group", "tp_packed"
# Fixed value: the key groups of a query unless it names another number. It is
# part of the state's layout: a query keeps the number it was started with.
KEY_GROUPS = 4096
# Rows of a task that are bundled at once.
BUNDLED_ROWS = 250_000
# Rows of a list or of a map's value that are kept with the key's small state.
LARGE_ROWS = 256


def key_group(keys: Sequence[str], groups: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias(GROUP)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.StringType)


def _packs(t: T.DataType) -> bool:
    """JSON gives back the values of this type (a double that is not finite
    as its name, see ``_unpacked``)."""
    return isinstance(t, (*_WHOLE, T.DoubleType)) or (
        isinstance(t, T.ArrayType) and isinstance(t.elementType, _WHOLE))


def grouped_rows(rows: DataFrame, keys: Sequence[str], groups: int) -> tuple[DataFrame, list]:
    """``rows`` as a group of keys takes them, and the names and types of the
    packed columns."""
    packed = [f for f in rows.schema.fields if _packs(f.dataType)]
    names = {f.name for f in packed}
    text = F.to_json(F.struct(*[F.col(f.name).alias(f"c{i}") for i, f in enumerate(packed)]),
                     {"ignoreNullFields": "false"})
    return rows.select(
        key_group(keys, groups), (text if packed else F.lit("{}")).alias(PACKED),
        *[c for c in rows.columns if c not in names]), packed


def _compressed(plain) -> bytes:
    """The number of bytes, and the bytes compressed."""
    return len(plain).to_bytes(8, "big") + pa.compress(plain, "zstd", asbytes=True)


def _decompressed(held: bytes) -> bytes:
    return pa.decompress(held[8:], int.from_bytes(held[:8], "big"), "zstd", asbytes=True)


def bundled(dealt: DataFrame) -> DataFrame:
    """Rows of :func:`grouped_rows` that are all packed, with those of one key
    group in a row as far as a task has them in hand: lines, compressed."""
    most = BUNDLED_ROWS

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield bundle(held)
                held, size = [], 0
        if size:
            yield bundle(held)

    def bundle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.set_column(1, PACKED, table[PACKED].cast(pa.large_binary()))
        table = table.sort_by(GROUP).combine_chunks()
        group = table[GROUP].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        text = table[PACKED].chunk(0)
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(group) + 1]
        at = at[np.append(first, len(group))].tolist()
        lines = [_compressed(data.slice(a, b - a)) for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(group[first], pa.int32()), pa.array(lines, pa.binary())],
            names=[GROUP, PACKED])

    lines = dealt.select(GROUP, F.concat(PACKED, F.lit("\n")).alias(PACKED))
    return lines.mapInArrow(bundles, f"{GROUP} int, {PACKED} binary")


def _texts(rows) -> Iterator[tuple]:
    """``(row, packed columns, other columns)`` of the rows, bundled or not."""
    for r in rows:
        _, text, *rest = r
        if isinstance(text, str):
            yield r, json.loads(text), rest
        else:
            lines = _decompressed(bytes(text)).decode().split("\n")[:-1]
            for line in lines:
                yield r, json.loads(line), rest


def _unpacked(rows, packed: list) -> Iterator[tuple]:
    """The rows as tuples that know their ``__fields__``: packed columns
    first. (Rows look up every access, by place too.)"""
    doubles = [i for i, f in enumerate(packed) if isinstance(f.dataType, T.DoubleType)]
    make = None
    for r, found, rest in _texts(rows):
        if make is None:
            names = [f.name for f in packed] + list(r.__fields__[2:])
            make = type("_Fields", (tuple,), {"__fields__": names})
        values = list(found.values())
        for i in doubles:
            if values[i] is not None:
                values[i] = float(values[i])
        yield make(values + rest)


def _hashable(v):
    """Equal for the values that Spark's grouping takes as equal."""
    if isinstance(v, float):
        return "NaN" if v != v else v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(_hashable(x) for x in v)
    return v


def _dumped(value) -> bytes:
    """``value`` as compressed bytes after their number. (All keys of a group
    with new rows are written anew, to the state store and its change log.)"""
    return _compressed(pickle.dumps(value, 5))


def _loaded(held: bytes):
    held = bytes(held)
    if held[:1] != b"\0":  # written before states were compressed
        return pickle.loads(held)
    return pickle.loads(_decompressed(held))


class _Key:
    """A key's states by name and its timers."""

    __slots__ = ("key", "states", "timers")

    def __init__(self, key, states, timers):
        self.key, self.states, self.timers = key, states, timers


class _Value:
    def __init__(self, group: KeyGroups, name: str):
        self.group, self.name = group, name

    def exists(self) -> bool:
        return self.name in self.group.now.states

    def get(self):
        return self.group.now.states.get(self.name)

    def update(self, value) -> None:
        self.group.now.states[self.name] = tuple(value)

    def clear(self) -> None:
        self.group.now.states.pop(self.name, None)


class _List:
    """Entries ``(numbers of the large parts, rows after them)``."""

    def __init__(self, group: KeyGroups, name: str):
        self.group, self.name = group, name

    def get(self) -> Iterator:
        parts, rows = self.group.now.states.get(self.name, ((), ()))
        for part in parts:
            yield from self.group.fetched(part)
        yield from rows

    def appendList(self, rows) -> None:
        parts, held = self.group.now.states.get(self.name, ([], []))
        held = [*held, *map(tuple, rows)]
        if len(held) > LARGE_ROWS:
            parts, held = [*parts, self.group.stored(held)], []
        self.group.now.states[self.name] = (parts, held)

    def put(self, rows) -> None:
        self.clear()
        self.appendList(rows)

    def clear(self) -> None:
        for part in self.group.now.states.pop(self.name, ((), ()))[0]:
            self.group.removed(part)


class _Map:
    """A value is a tuple of equally long columns: ``(value, None)``, or
    ``(None, number of its large part)``."""

    def __init__(self, group: KeyGroups, name: str):
        self.group, self.name = group, name

    def _held(self) -> dict:
        return self.group.now.states.setdefault(self.name, {})

    def getValue(self, key):
        value, part = self._held()[tuple(key)]
        return value if part is None else self.group.fetched(part)

    def updateValue(self, key, value) -> None:
        self.removeKey(key)
        large = any(len(c) > LARGE_ROWS for c in value)
        self._held()[tuple(key)] = (None, self.group.stored(value)) if large else (value, None)

    def removeKey(self, key) -> None:
        _, part = self._held().pop(tuple(key), (None, None))
        if part is not None:
            self.group.removed(part)


class KeyGroups(StatefulProcessor):
    """``processor`` (of one key) for all keys of a key group. Input rows are
    those of :func:`grouped_rows`: the columns ``key_cols`` and those that the
    processor reads; it sees the same calls as if Spark had grouped by the
    key."""

    def __init__(self, processor: StatefulProcessor, key_cols: Sequence[str], packed: list):
        self.processor = processor
        self.key_cols = list(key_cols)
        self.packed = packed
        plain = {f.name for f in packed if isinstance(f.dataType, _WHOLE)}
        self.hashable = tuple if plain.issuperset(key_cols) else _hashable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the keys' states and timers, the timer set for the group, and the
        # number of the next large part
        self.group = handle.getValueState("group", "keys binary, timer long, next_part long")
        self.parts = handle.getMapState("parts", "part long", "rows binary")
        self.now: _Key | None = None
        self.processor.init(self)

    # what the processor sees as its handle

    def getValueState(self, name: str, schema) -> _Value:
        return _Value(self, name)

    def getListState(self, name: str, schema) -> _List:
        return _List(self, name)

    def getMapState(self, name: str, key_schema, value_schema) -> _Map:
        return _Map(self, name)

    def registerTimer(self, at_ms: int) -> None:
        self.now.timers.add(int(at_ms))

    # large parts

    def stored(self, rows) -> int:
        self.next_part += 1
        self.parts.updateValue((self.next_part,), (_dumped(rows),))
        return self.next_part

    def fetched(self, part: int):
        return _loaded(self.parts.getValue((part,))[0])

    def removed(self, part: int) -> None:
        self.parts.removeKey((part,))

    # the group

    def _load(self) -> dict:
        found = self.group.get()
        if found is None:
            self.timer, self.next_part = None, 0
            return {}
        self.timer, self.next_part = found[1], found[2]
        return {self.hashable(k): _Key(k, states, set(timers))
                for k, states, timers in _loaded(found[0])}

    def _save(self, keys: dict) -> None:
        held = [(k.key, k.states, tuple(k.timers)) for k in keys.values()
                if k.states or k.timers]
        first = min((t for _, _, timers in held for t in timers), default=None)
        if first != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if first is not None:
                self.handle.registerTimer(first)
        if held:
            self.group.update((_dumped(held), first, self.next_part))
        else:
            self.group.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own: dict = {}
        at = None
        for r in _unpacked(rows, self.packed):
            if at is None:
                at = [r.__fields__.index(c) for c in self.key_cols]
            k = tuple(r[i] for i in at)
            own.setdefault(self.hashable(k), (k, []))[1].append(r)
        if not own:
            return
        keys = self._load()
        for h, (k, new) in own.items():
            self.now = keys.get(h)
            if self.now is None:
                self.now = keys[h] = _Key(k, {}, set())
            yield from self.processor.handleInputRows(self.now.key, iter(new), timerValues)
        self._save(keys)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        keys = self._load()
        upto = expiredTimerInfo.getExpiryTimeInMs()
        wm = timerValues.getCurrentWatermarkInMs()
        if self.timer is not None and self.timer <= upto:
            self.timer = None  # this one
        for self.now in list(keys.values()):
            due = {t for t in self.now.timers if t <= upto or t < wm}
            if due:
                self.now.timers -= due
                yield from self.processor.handleExpiredTimer(
                    self.now.key, timerValues, expiredTimerInfo)
        self._save(keys)

    def close(self) -> None:
        self.processor.close()
