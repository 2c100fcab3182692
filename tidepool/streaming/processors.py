"""Keyed stateful processors for Structured Streaming (``transformWithState``).

Each processor keeps a small per-key state in the state store (RocksDB) and
sees one key's new rows per micro-batch, as tuples with ``__fields__`` or
Rows; rows are put in order inside the key before they are applied. The per-row code here is the fold of one key's
rows; grouping, shuffling, checkpointing and recovery are Spark's. The Row
interface is used (not the pandas one): a key's rows per micro-batch are
few, and per-key pandas frames cost several times more than the fold.
Every state access would be a round trip to the state store: the streaming
operators run a processor for groups of keys (``key_groups``), which read and
write the states of their keys at once. A key's new
rows of one micro-batch are held in memory together; bound micro-batches on
the source (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``) so that a hot
key's share of one batch stays small.
"""

from __future__ import annotations

import bisect
import datetime as dt
import heapq
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_NO_TIMER = -1
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _row(names, values) -> Row:
    return Row(**dict(zip(names, values)))


def _ms_ceil(us: int) -> int:
    return -((-int(us)) // 1000)


# --- sessions closed by a gap or a final event (event time) -----------------

# Pending rows of a bucket: a stretch of time of one key and micro-batch.
BUCKET_ROWS = 1_000
SESSION_STATE = ("seq long, start long, last long, n long, v long, lone boolean, "
                 "active boolean, done_upto long, timer long, next_bucket long, "
                 "bucket_first array<long>, bucket_id array<long>")
BUCKET_STATE = "t array<long>, fin array<boolean>, tb array<long>, v array<long>"
LATE_FIELDS = ["late_event_us", "late_tiebreak", "late_value", "watermark_us"]


class _Session:
    """The value state of a key; ``buckets`` holds ``(first time, id)`` of its
    pending buckets."""

    def __init__(self, row=None):
        (self.seq, self.start, self.last, self.n, self.v, self.lone, self.active, self.done,
         self.timer, self.next_bucket, first, ids) = row or (
            0, 0, 0, 0, 0, False, False, -(2 ** 62), _NO_TIMER, 0, [], [])
        self.buckets = list(zip(first or [], ids or []))

    def row(self) -> tuple:
        return (self.seq, self.start, self.last, self.n, self.v, self.lone, self.active, self.done,
                self.timer, self.next_bucket, [f for f, _ in self.buckets],
                [i for _, i in self.buckets])


class FinalSessionProcessor(StatefulProcessor):
    """Gap sessions per key, ended early by a final event.

    Input columns: the key, ``ev_t`` (event time, epoch µs), ``ev_final``,
    ``ev_tb`` (tiebreak) and ``ev_v`` (a value summed per session). Rows
    wait in state until the watermark passes them, then are applied in
    ``(ev_t, ev_final, ev_tb)`` order, so out-of-order arrival within the
    allowed lateness gives the batch result. A session is emitted when a
    final closes it, when a later row starts a new one, or when the
    watermark passes ``last + gap``.

    Waiting rows are kept in buckets of at most ``BUCKET_ROWS`` rows of
    consecutive times, a map state of its own key each; a timer reads only
    the buckets that begin at or before the watermark, in time order, and
    holds only those that overlap.

    A row is late if it is older than what was already applied, or would have
    joined a session that the watermark has closed. Late rows are dropped, or
    with ``emit_late`` come out as rows of their own: session columns NULL,
    ``late_event_us``, ``late_tiebreak``, ``late_value`` and the
    ``watermark_us`` at their arrival filled.

    ``lone_final="close"``: a final that starts a session is a closed
    one-row session. ``"absorb"``: such a session takes every later row of
    the key regardless of gaps until the next final closes it.

    ``end_time`` adds the session's end as a timestamp, ``session_end``: the
    event time of a stateful operator that follows, in whole milliseconds
    (rounded up, as timers are). It has to lie after the watermark before:
    watermarks begin in 1970, so an earlier end is carried as 1 ms later.
    """

    def __init__(self, key_cols: list[str], gap_us: int, lone_final: str = "close",
                 emit_late: bool = False, end_time: bool = False):
        if gap_us <= 0:
            raise ValueError("gap must be strictly positive")
        if lone_final not in ("close", "absorb"):
            raise ValueError("lone_final must be 'close' or 'absorb'")
        if emit_late and end_time:
            raise ValueError("late rows have no session end")
        self.key_cols = list(key_cols)
        self.gap_us = int(gap_us)
        self.lone_final = lone_final
        self.emit_late = emit_late
        self.end_time = end_time
        self.names = self.key_cols + ["session_seq", "session_start_us", "session_end_us",
                                      "closed", "n_events", "value_cents"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION_STATE)
        self.pending = handle.getMapState("pending", "bucket long", BUCKET_STATE)

    def _put(self, st: _Session, rows: list[tuple]) -> None:
        """A bucket of rows in order."""
        self.pending.updateValue((st.next_bucket,), tuple(list(c) for c in zip(*rows)))
        st.buckets.append((rows[0][0], st.next_bucket))
        st.next_bucket += 1

    def _ready(self, st: _Session, wm_us: int) -> Iterator[tuple]:
        """The rows up to the watermark, in order; what is left of their
        buckets goes back."""
        due = sorted(b for b in st.buckets if b[0] <= wm_us)
        st.buckets = [b for b in st.buckets if b[0] > wm_us]
        heap: list[tuple] = []
        for first, bucket in due:
            while heap and heap[0][0] < first:
                yield heapq.heappop(heap)
            rows = list(zip(*self.pending.getValue((bucket,))))
            self.pending.removeKey((bucket,))
            cut = bisect.bisect_right(rows, wm_us, key=lambda r: r[0])
            if cut < len(rows):
                self._put(st, rows[cut:])
            for r in rows[:cut]:
                heapq.heappush(heap, r)
        while heap:
            yield heapq.heappop(heap)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        if not rows:
            return iter(())
        st = _Session(self.session.get())
        names = ("ev_t", "ev_final", "ev_tb", "ev_v")
        fields = getattr(rows[0], "__fields__", None)  # none: rows are mappings
        at, af, ab, av = map(fields.index, names) if fields else names
        own = sorted((r[at], bool(r[af]), r[ab], r[av]) for r in rows)
        cut = bisect.bisect_left(own, st.done, key=lambda r: r[0])
        late, new = own[:cut], own[cut:]
        for i in range(0, len(new), BUCKET_ROWS):
            self._put(st, new[i:i + BUCKET_ROWS])
        if new:
            at = _ms_ceil(new[0][0])
            if st.timer == _NO_TIMER or at < st.timer:
                self.handle.registerTimer(at)
                st.timer = at
            self.session.update(st.row())
        if not late or not self.emit_late:
            return iter(())
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        none = [None] * (len(self.names) - len(self.key_cols))
        return iter([_row(self.names + LATE_FIELDS, (*key, *none, t, tb, v, wm_us))
                     for t, _, tb, v in late])

    def _emit(self, key, out, st: _Session, closed: bool, end_us: int) -> None:
        names, values = self.names, (*key, st.seq, st.start, end_us, closed, st.n, st.v)
        if self.emit_late:
            names, values = names + LATE_FIELDS, (*values, None, None, None, None)
        if self.end_time:
            names = names + ["session_end"]
            values = (*values, _EPOCH + dt.timedelta(milliseconds=max(1, _ms_ceil(end_us))))
        out.append(_row(names, values))
        st.active = False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        st = _Session(self.session.get())
        out: list[Row] = []
        gap = self.gap_us
        absorb = self.lone_final == "absorb"
        for (rt, fin, _tb, rv) in self._ready(st, wm_us):
            st.done = max(st.done, rt)
            if st.active and not (st.lone and absorb) and rt - st.last >= gap:
                self._emit(key, out, st, False, st.last + gap)
            if not st.active:
                st.seq, st.start, st.last, st.n, st.v = st.seq + 1, rt, rt, 1, rv
                st.active, st.lone = True, fin
                if fin and not absorb:
                    self._emit(key, out, st, True, rt)
                continue
            st.last, st.n, st.v = rt, st.n + 1, st.v + rv
            if fin:
                self._emit(key, out, st, True, rt)
        waits = st.active and not (st.lone and absorb)
        if waits and st.last + gap <= wm_us:
            self._emit(key, out, st, False, st.last + gap)
            st.done = max(st.done, st.last + gap)  # nothing may join it any more
            waits = False
        nxt = [f for f, _ in st.buckets] + ([st.last + gap] if waits else [])
        st.timer = _NO_TIMER
        if nxt:
            st.timer = _ms_ceil(min(nxt))
            self.handle.registerTimer(st.timer)
        self.session.update(st.row())
        return iter(out)

    def close(self) -> None:
        pass


# --- keyed alignment (arrival order = processing order) ---------------------


def _none_first(values) -> tuple:
    return tuple((v is not None, v) for v in values)


class SyncProcessor(StatefulProcessor):
    """N-way alignment per key. Input columns: ``key``, ``src`` (input
    index), ``arr0, arr1, ...`` (arrival order inside a micro-batch; NULL
    first) and ``value_0 .. value_{N-1}`` (only the row's own input set).

    ``occurrence``: keeps a queue per input; emits the heads once every
    input has one. ``arrival``: emits every N consecutive arrivals. Rows that
    complete nothing are appended to the state; it is read and rewritten only
    when rows are emitted.
    """

    def __init__(self, n_inputs: int, value_ddl: list[str], order_ddl: list[str],
                 match: str = "occurrence", flush_at_ms: int | None = None):
        if n_inputs <= 0:
            raise ValueError("need at least one input")
        if match not in ("occurrence", "arrival"):
            raise ValueError("match must be 'occurrence' or 'arrival'")
        self.n = n_inputs
        self.value_ddl = value_ddl
        self.order_ddl = order_ddl
        self.match = match
        # "longest": when the watermark reaches flush_at_ms (the end of the
        # stream), pending values are emitted as incomplete rows
        self.flush_at_ms = flush_at_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        cols = ", ".join([f"arr{i} {t}" for i, t in enumerate(self.order_ddl)]
                         + [f"value_{i} {t}" for i, t in enumerate(self.value_ddl)])
        self.pending = handle.getListState("pending", f"src int, {cols}")
        # rows emitted, rows held, and how many of them per input
        self.emitted = handle.getValueState("emitted", "n long, held long, queues array<long>")

    def _value(self, row, i: int):
        return row[1 + len(self.order_ddl) + i]

    def _order(self, row) -> tuple:
        return (*_none_first(row[1:1 + len(self.order_ddl)]), row[0])

    def _group(self, key, place: int, rows) -> Row:
        vals = [f"value_{i}" for i in range(self.n)]
        return _row(["key", "group", "srcs", "items"], (
            key[0], place, ",".join(str(r[0]) for r in rows),
            [_row(["src", *vals], (r[0], *[self._value(r, i) for i in range(self.n)]))
             for r in rows]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        vals = [f"value_{i}" for i in range(self.n)]
        arr = [f"arr{i}" for i in range(len(self.order_ddl))]
        rows = list(rows)
        if not rows:
            return iter(())
        # positions, not names: see CompletionProcessor
        at = [rows[0].__fields__.index(c) for c in ("src", *arr, *vals)]
        new = sorted((tuple([r[i] for i in at]) for r in rows), key=self._order)
        e = self.emitted.get()
        done, held, queued = (e[0], e[1], list(e[2])) if e is not None else (0, 0, [0] * self.n)
        for r in new:
            queued[r[0]] += 1
        ready = min(queued) if self.match == "occurrence" else (held + len(new)) // self.n
        if self.flush_at_ms is not None and not held:
            self.handle.registerTimer(self.flush_at_ms)
        if not ready:
            self.pending.appendList(new)
            self.emitted.update((done, held + len(new), queued))
            return iter(())
        pend = (list(self.pending.get()) if held else []) + new
        out = []
        if self.match == "occurrence":
            queues = [[r for r in pend if r[0] == i] for i in range(self.n)]
            for j in range(ready):
                out.append(_row(["key", "occurrence", *vals], (key[0], done + j + 1, *[
                    self._value(queues[i][j], i) for i in range(self.n)])))
            taken = [0] * self.n
            rest = []
            for r in pend:
                taken[r[0]] += 1
                if taken[r[0]] > ready:
                    rest.append(r)
        else:
            for j in range(ready):
                out.append(self._group(key, done + j + 1, pend[j * self.n:(j + 1) * self.n]))
            rest = pend[ready * self.n:]
        if held:
            self.pending.clear()
        if rest:
            self.pending.put([tuple(r) for r in rest])
        queued = [0] * self.n
        for r in rest:
            queued[r[0]] += 1
        self.emitted.update((done + ready, len(rest), queued))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """End of stream: what is still pending forms incomplete rows."""
        e = self.emitted.get()
        if e is None or not e[1]:
            return iter(())
        done = e[0]
        pend = list(self.pending.get())
        vals = [f"value_{i}" for i in range(self.n)]
        out = []
        if self.match == "occurrence":
            queues = [[r for r in pend if r[0] == i] for i in range(self.n)]
            for j in range(max(len(q) for q in queues)):
                out.append(_row(["key", "occurrence", *vals], (key[0], done + j + 1, *[
                    self._value(queues[i][j], i) if j < len(queues[i]) else None
                    for i in range(self.n)])))
        else:
            out.append(self._group(key, done + 1, pend))
        self.pending.clear()
        self.emitted.update((done + len(out), 0, [0] * self.n))
        return iter(out)

    def close(self) -> None:
        pass


# --- completion of work payloads ---------------------------------------------

# So many outputs of a key are kept beside its count; more go to a list state.
INLINE_PATHS = 256
COMPLETION_STATE = ("seen long, fired long, first long, last long, timer long, spilled boolean, "
                    "paths array<string>")


class CompletionProcessor(StatefulProcessor):
    """Counts a key's payloads in arrival order; when the count reaches the
    declared number it emits the collected outputs and starts again.
    Input columns: the key, ``arr0, arr1, ...`` (arrival order inside a
    micro-batch), ``expected`` and ``output`` (a NULL output adds nothing),
    and with ``idle_us`` also ``ev_t`` (event time, epoch µs).

    A value state holds the count, the number of firings and a few outputs;
    more outputs are appended to a list state that is read only to fire.

    Without ``idle_us`` a key's state lives for ever. With it, a key without
    payloads for so long (to its next payload, or to the watermark) is
    forgotten: what it had collected comes out as a row with ``complete``
    false, and its firings are numbered from 1 again. Rows then also carry
    ``first_us`` and ``last_us``, the times of the first and last payload
    counted."""

    def __init__(self, key_cols: list[str], n_arrival: int, idle_us: int | None = None):
        if idle_us is not None and idle_us <= 0:
            raise ValueError("idle time must be strictly positive")
        self.key_cols = list(key_cols)
        self.arr = [f"arr{i}" for i in range(n_arrival)]
        self.idle_us = idle_us
        self.names = self.key_cols + ["fire", "n_payloads", "outputs"] + (
            ["complete", "first_us", "last_us"] if idle_us else [])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", COMPLETION_STATE)
        self.paths = handle.getListState("paths", "path string")

    def _emitted(self, key, fire, seen, new, spilled, complete, first, last) -> Row:
        if spilled:
            new = [p[0] for p in self.paths.get()] + new
            self.paths.clear()
        values = (*key, fire, seen, new)
        return _row(self.names, (*values, complete, first, last) if self.idle_us else values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        if not rows:
            return iter(())
        # positions, not names: Row lookups by name scan the field list
        fields = rows[0].__fields__
        ia = [fields.index(c) for c in self.arr]
        ie, io = fields.index("expected"), fields.index("output")
        it = fields.index("ev_t") if self.idle_us else None
        if len(rows) > 1:
            rows.sort(key=lambda r: _none_first(r[i] for i in ia))
        st = self.state.get()
        seen, fired, first, last, timer, spilled, new = tuple(st) if st is not None else (
            0, 0, 0, None, _NO_TIMER, False, [])
        new = list(new or [])
        out = []
        for r in rows:
            if it is not None:
                t = r[it]
                if last is not None and t - last >= self.idle_us:
                    if seen:
                        out.append(self._emitted(key, fired + 1, seen, new, spilled, False,
                                                 first, last))
                    seen, fired, new, spilled, last = 0, 0, [], False, t
                if not seen:
                    first = t
                last = t if last is None else max(last, t)
            seen += 1
            new.extend(r[io] or [])
            if r[ie] is not None and seen == r[ie]:
                fired += 1
                out.append(self._emitted(key, fired, seen, new, spilled, True, first, last))
                seen, new, spilled = 0, [], False
        if len(new) > INLINE_PATHS:
            self.paths.appendList([(p,) for p in new])
            new, spilled = [], True
        if it is not None and timer == _NO_TIMER:
            timer = _ms_ceil(last + self.idle_us)
            self.handle.registerTimer(timer)
        self.state.update((seen, fired, first, last, timer, spilled, new))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        st = self.state.get()
        if st is None:
            return iter(())
        seen, fired, first, last, _, spilled, new = tuple(st)
        if last + self.idle_us > timerValues.getCurrentWatermarkInMs() * 1000:
            timer = _ms_ceil(last + self.idle_us)  # payloads came since it was set
            self.handle.registerTimer(timer)
            self.state.update((seen, fired, first, last, timer, spilled, list(new or [])))
            return iter(())
        out = [self._emitted(key, fired + 1, seen, list(new or []), spilled, False, first, last)] \
            if seen else []
        self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass
