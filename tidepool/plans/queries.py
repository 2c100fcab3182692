"""Registered queries: the library's operators run over the driver's tables.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
columns match the DuckDB oracle of the same name (:mod:`tidepool.plans.oracles`).
Outputs are scalar (BIGINT / STRING / BOOLEAN; times as epoch microseconds)
so both engines hash them alike.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.parse import first_word_more, game_event_rejects, parse_game_event
from tidepool.functions.scalar import (as_float, as_int, as_str, assign_event_time, decode_utf8,
                                       encode_bytes, format_pair, format_score, key_by, multiply,
                                       now_iso, path_join, random_value, split_tokens,
                                       timestamp_text, value_range, with_event_time)
from tidepool.functions.rows import flat_map
from tidepool.operators.align import flatten, sync, sync_tagged
from tidepool.operators.combine import combine_by_key
from tidepool.operators.completion import (job_output, job_output_all_levels,
                                           job_output_and_rest, job_output_rows, level_keys,
                                           ready_keys)
from tidepool.operators.route import (dead_letter, dead_letter_expr, errors, fail_on_value,
                                      filter_by_attributes,
                                      row_budget_guard, split_threshold, tap)
from tidepool.operators.scores import scores_by_field, total_score, user_score
from tidepool.operators.sessions import (fixed_windows, session_windows,
                                         sessions_with_final, to_global_window)
from tidepool.operators.windows import merged_windows
from tidepool.plans import inputs as I
from tidepool.session import STATE_STORE, claimed_path, dropped, session_settings
from tidepool.sinks import with_attributes, write_lines, write_messages
from tidepool.sources.files import read_lines
from tidepool.sources.messages import (event_time_from_attribute, read_message_strings,
                                       read_messages)
from tidepool.streaming.counters import StreamCounters
from tidepool.streaming.fan_out import KeyedBranch, run_fan_out
from tidepool.streaming.operators import (late_only, on_time, stream_fixed_window_counts, stream_group_values,
                                          stream_job_output, stream_session_totals,
                                          stream_sessions_with_final, stream_sync_tagged)
from tidepool.streaming.replay import (replay_stream, run_to_table, run_updates_to_table,
                                       write_replay_files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SIX_HOURS = 6 * 3600


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def register_stateful(name: str):
    """A query that runs a stream with keyed state: whatever state store the
    session names, it runs on RocksDB, and the session's setting comes back."""
    def deco(fn):
        @functools.wraps(fn)
        def query(spark, sf):
            with session_settings(spark, STATE_STORE):
                return fn(spark, sf)

        return register(name)(query)
    return deco


def _us(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _cents(c: str = "value") -> F.Column:
    return F.round(F.col(c) * 100).cast("bigint")


# --- scores (parse -> event time -> grouped scores) -------------------------

def _events(spark, sf):
    return I.table(spark, sf, "events")


def _parsed(spark, sf):
    return parse_game_event(I.game_lines(_events(spark, sf)))


@register("user_scores_sorted")
def q_user_scores_sorted(spark, sf):
    """Every score of every user, ascending, as (user, score, n) runs."""
    return user_score(I.game_lines(_events(spark, sf)))


@register("team_scores_sorted")
def q_team_scores_sorted(spark, sf):
    return scores_by_field(_parsed(spark, sf), "team")


@register("user_total_score")
def q_user_total_score(spark, sf):
    return total_score(_parsed(spark, sf), "user")


@register("team_total_score")
def q_team_total_score(spark, sf):
    return total_score(_parsed(spark, sf), "team")


@register("score_text")
def q_score_text(spark, sf):
    t = total_score(_parsed(spark, sf), "user")
    return t.select("user", format_score(F.col("user"), F.col("total_score")).alias("text"))


@register("parse_rejects")
def q_parse_rejects(spark, sf):
    return game_event_rejects(I.game_lines(_events(spark, sf)))


@register("parse_reject_counts")
def q_parse_reject_counts(spark, sf):
    return (game_event_rejects(I.game_lines(_events(spark, sf)))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


# --- sessions ---------------------------------------------------------------

def _strict_sessions(spark, sf):
    return session_windows(_events(spark, sf), "user_id", "ts", SIX_HOURS,
                           tiebreak=["event_id"],
                           aggs=[F.sum(_cents()).alias("value_cents")])


@register("sessions_strict")
def q_sessions_strict(spark, sf):
    s = _strict_sessions(spark, sf)
    return s.select("user_id", "session_seq",
                    _us("session_start").alias("session_start_us"),
                    _us("session_end").alias("session_end_us"),
                    _us("event_time").alias("event_time_us"),
                    "n_events", "value_cents")


@register("sessions_to_global")
def q_sessions_to_global(spark, sf):
    s = _strict_sessions(spark, sf)
    return to_global_window(s, "user_id", [
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_events").alias("n_events"),
        F.max("n_events").alias("longest_session"),
        F.sum("value_cents").alias("value_cents")])


@register("sessions_with_final")
def q_sessions_with_final(spark, sf):
    s = sessions_with_final(_events(spark, sf), "user_id", "ts", SIX_HOURS,
                            is_final=F.col("event_type") == "purchase",
                            tiebreak=["event_id"])
    return s.select("user_id", "session_seq",
                    _us("session_start").alias("session_start_us"),
                    _us("session_end").alias("session_end_us"),
                    "closed", "n_events")


@register("sessions_absorb")
def q_sessions_absorb(spark, sf):
    """sessions_with_final in which a final that starts a session absorbs
    what follows until the next final."""
    s = sessions_with_final(_events(spark, sf), "user_id", "ts", SIX_HOURS,
                            is_final=F.col("event_type") == "purchase",
                            tiebreak=["event_id"], lone_final="absorb")
    return s.select("user_id", "session_seq", _us("session_start").alias("session_start_us"),
                    F.coalesce(_us("session_end"), F.lit(-1)).alias("session_end_us"),
                    "closed", "n_events")


@register("fixed_windows_count")
def q_fixed_windows_count(spark, sf):
    w = fixed_windows(_events(spark, sf), "ts", 5)
    return (w.groupBy(F.col("window.start").alias("ws"), "event_type")
             .agg(F.count(F.lit(1)).alias("n"))
             .select(_us("ws").alias("window_start_us"), "event_type", "n"))


@register("first_word_more")
def q_first_word_more(spark, sf):
    lines = I.document_lines(I.table(spark, sf, "documents"))
    return (first_word_more(lines, "line")
            .groupBy("word", "more").agg(F.count(F.lit(1)).alias("n")))


# --- alignment --------------------------------------------------------------

def _tagged(spark, sf):
    return I.tagged_branches(_events(spark, sf))


_N_BRANCHES = len(I.BRANCH_TYPES)


def _occurrence_view(df):
    return df.select("key", "occurrence", "value_0", "value_1",
                     F.round(F.col("value_2") * 100).cast("bigint").alias("value_2_cents"),
                     F.size("value_3").cast("bigint").alias("value_3_size"), "value_4")


def _item_text(x):
    """One aligned value as text: ints, strings, cents, ``r<size>`` for lists."""
    return F.coalesce(x["value_0"].cast("string"), x["value_1"],
                      F.round(x["value_2"] * 100).cast("bigint").cast("string"),
                      F.concat(F.lit("r"), F.size(x["value_3"]).cast("string")), x["value_4"])


@register("sync_occurrence")
def q_sync_occurrence(spark, sf):
    """n-th click, view, purchase, signup and error event of each user as
    one row."""
    return _occurrence_view(sync_tagged(_tagged(spark, sf), _N_BRANCHES, match="occurrence"))


@register("sync_longest")
def q_sync_longest(spark, sf):
    """Like sync_occurrence, incomplete rows kept (absent values NULL; the
    numbers are rendered as text so NULLs survive the value hash)."""
    o = _occurrence_view(sync_tagged(_tagged(spark, sf), _N_BRANCHES, match="occurrence",
                                     mode="longest"))
    return o.select("key", "occurrence", F.col("value_0").cast("string").alias("value_0"),
                    "value_1", F.col("value_2_cents").cast("string").alias("value_2_cents"),
                    F.col("value_3_size").cast("string").alias("value_3_size"), "value_4")


@register("sync_arrival")
def q_sync_arrival(spark, sf):
    """Every five consecutive arrivals of a user as one row."""
    s = sync_tagged(_tagged(spark, sf), _N_BRANCHES, match="arrival")
    return s.select("key", "group",
                    F.array_join(F.transform("items", lambda x: x["src"].cast("string")), ",")
                     .alias("srcs"),
                    F.array_join(F.transform("items", _item_text), "|").alias("values_text"))


@register("flatten_union")
def q_flatten_union(spark, sf):
    e = _events(spark, sf).select("event_id", "event_type", "value")
    return flatten(e.where(F.col("value") < 100), e.where(F.col("event_type") == "view")) \
        .select("event_id", "event_type")


# --- completion -------------------------------------------------------------

def _payloads(spark, sf):
    return I.payloads_from_lineitem(I.table(spark, sf, "lineitem"))


def _fired_view(df, keys):
    return df.select(*keys, "fire", "n_payloads",
                     F.size("outputs").cast("bigint").alias("n_outputs"),
                     F.array_join("outputs", "|").alias("outputs_text"))


@register("job_output_task")
def q_job_output_task(spark, sf):
    o = job_output(_payloads(spark, sf), "taskid")
    return o.groupBy("graphid", "jobid").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum(F.size("outputs")).cast("bigint").alias("n_outputs"))


@register("job_output_job")
def q_job_output_job(spark, sf):
    o = job_output(_payloads(spark, sf), "jobid", arrival=I.PAYLOAD_ARRIVAL)
    return _fired_view(o, ["graphid", "jobid"])


@register("job_output_graph")
def q_job_output_graph(spark, sf):
    o = job_output(_payloads(spark, sf), "graphid", arrival=I.PAYLOAD_ARRIVAL)
    return _fired_view(o, ["graphid"])


@register("job_output_all_levels")
def q_job_output_all_levels(spark, sf):
    o = job_output_all_levels(_payloads(spark, sf), arrival=I.PAYLOAD_ARRIVAL)
    return o.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum(F.size("outputs")).cast("bigint").alias("n_outputs"))


@register("job_output_varied")
def q_job_output_varied(spark, sf):
    """Completed graphs whose payloads declare changing numbers."""
    o = job_output(I.varied_payloads(_events(spark, sf)), "graphid", arrival=I.VARIED_ARRIVAL)
    return _fired_view(o, ["graphid"])


@register("merged_windows")
def q_merged_windows(spark, sf):
    """Windows of 10 minutes to 6 hours, an event each, merged per user."""
    w = merged_windows(I.variable_windows(_events(spark, sf)), "user_id", "window_from",
                       "window_to", aggs=[F.sum(_cents()).alias("value_cents")])
    return w.select("user_id", "window_seq", _us("window_start").alias("window_start_us"),
                    _us("window_end").alias("window_end_us"), "n_events", "value_cents")


# --- filters, routes, guards ------------------------------------------------

_PROPS = "k INT"


def _messages(spark, sf):
    return I.messages_from_events(_events(spark, sf))


def _decoded_view(df):
    return df.select(F.col("attributes")["id"].cast("bigint").alias("event_id"),
                     F.col("payload.k").alias("k"))


@register("filter_attributes")
def q_filter_attributes(spark, sf):
    return _decoded_view(filter_by_attributes(
        _messages(spark, sf), {"event_type": "purchase"}, schema=_PROPS))


@register("filter_attributes_list")
def q_filter_attributes_list(spark, sf):
    return _decoded_view(filter_by_attributes(
        _messages(spark, sf), {"event_type": ["view"], "timestamp": []}, schema=_PROPS))


@register("filter_attributes_chars")
def q_filter_attributes_chars(spark, sf):
    return _decoded_view(filter_by_attributes(
        _messages(spark, sf), {"event_type": "kcil"}, schema=_PROPS, match="chars"))


@register("decode_all_messages")
def q_decode_all_messages(spark, sf):
    return _decoded_view(filter_by_attributes(_messages(spark, sf), None, schema=_PROPS))


@register("split_threshold")
def q_split_threshold(spark, sf):
    return split_threshold(_events(spark, sf), "value", 50.0).select("event_id", "route")


def _reject_error_events(event_type):
    if event_type == "error":
        raise ValueError("error events are not accepted")


@register("dead_letter")
def q_dead_letter(spark, sf):
    """Failing calls (retried, then dead-lettered) with their errors."""
    d = dead_letter(_events(spark, sf), _reject_error_events, ["event_type"],
                    initial_delay=0.0)
    return errors(d).select("event_id", "error.error_class", "error.message")


@register("dead_letter_main")
def q_dead_letter_main(spark, sf):
    d = dead_letter(_events(spark, sf), _reject_error_events, ["event_type"],
                    initial_delay=0.0, keep_failed=True)
    return d.select("event_id", F.col("error").isNotNull().alias("failed"))


@register("fail_on_value")
def q_fail_on_value(spark, sf):
    e = _events(spark, sf)
    return fail_on_value(e, F.col("value") < 0, "negative value").select("event_id", "value")


@register("row_budget_guard")
def q_row_budget_guard(spark, sf):
    e = _events(spark, sf)
    return row_budget_guard(e, 1_000_000_000, ["user_id"]).select("event_id", "user_id")


@register("tap_events")
def q_tap_events(spark, sf):
    return tap(_events(spark, sf), "events").select("event_id", "event_type")


# --- projections ------------------------------------------------------------

@register("split_tokens")
def q_split_tokens(spark, sf):
    d = I.table(spark, sf, "documents").select("text")
    return split_tokens(d, "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("value_range")
def q_value_range(spark, sf):
    r = value_range(F.floor("value"))
    return _events(spark, sf).select(
        "event_id", F.size(r).cast("bigint").alias("range_size"),
        F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("range_sum"))


@register("multiply")
def q_multiply(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", multiply(encode_bytes(F.col("event_id")), 3).alias("tripled"))


@register("path_join")
def q_path_join(spark, sf):
    e = _events(spark, sf)
    parts = F.array(F.lit("/beam"), F.concat(F.lit("user-"), F.col("user_id").cast("string")),
                    F.when(F.col("event_type") == "error", F.lit("/errors"))
                     .otherwise(F.col("event_type")),
                    F.concat(F.col("event_id").cast("string"), F.lit(".ext")))
    return e.select("event_id", path_join(parts).alias("path"))


@register("cast_branches")
def q_cast_branches(spark, sf):
    e = I.number_texts(_events(spark, sf))
    return e.select("event_id", as_int("k_text").alias("as_int"),
                    as_str("k_text").alias("as_str"),
                    F.round(as_float("k_text") * 100).cast("bigint").alias("as_float_cents"))


@register("encode_decode")
def q_encode_decode(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "text")
    b = encode_bytes(F.col("text"))
    return d.select("doc_id", F.octet_length(b).cast("bigint").alias("n_bytes"),
                    (decode_utf8(b, strict=True) == F.col("text")).alias("roundtrip"))


@register("word_count_text")
def q_word_count_text(spark, sf):
    lines = I.document_lines(I.table(spark, sf, "documents"))
    c = first_word_more(lines, "line").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return c.select("word", format_pair(F.col("word"), F.col("n")).alias("text"))


@register("timestamp_text")
def q_timestamp_text(spark, sf):
    e = with_event_time(_events(spark, sf), "ts")
    return e.select("event_id", timestamp_text(F.col("ts")).alias("text"), "is_end")


# --- streaming twins (table replayed as time-ordered files) -----------------

_END_TYPE = "__end__"


def _drained(stream, name, replay):
    """The rows of a stream run to its end; its replay copy is deleted."""
    out = run_to_table(stream, name)
    dropped(replay)
    return out


def _events_replay(spark, sf, n_slices=3):
    """The events table as a stream of ``n_slices`` time-ordered slices, then
    one end-of-stream row far in the future that pushes the watermark past
    all data (it never reaches an operator)."""
    import datetime as _dt
    e = _events(spark, sf)
    end = spark.createDataFrame(
        [(-1, _dt.datetime(9999, 12, 31), -1, _END_TYPE, 0.0, "{}")], e.schema)
    path, n = write_replay_files(e, "ts", n_slices, end_rows=end)
    return replay_stream(spark, path, e.schema, n), path


def _is_end():
    return F.col("event_type") == _END_TYPE


@register_stateful("stream_final_sessions")
def q_stream_final_sessions(spark, sf):
    """sessions_with_final on a stream: state and event-time timers."""
    events, path = _events_replay(spark, sf)
    s = stream_sessions_with_final(
        events, "user_id", "ts", SIX_HOURS,
        is_final=F.col("event_type") == "purchase", tiebreak="event_id",
        value=_cents(), end_marker=_is_end())
    return _drained(s, "stream-final-sessions", path).select(
        "user_id", "session_seq", "session_start_us", "session_end_us", "closed", "n_events")


@register_stateful("stream_sessions")
def q_stream_sessions(spark, sf):
    """sessions_strict on a stream."""
    events, path = _events_replay(spark, sf)
    s = stream_sessions_with_final(events, "user_id", "ts", SIX_HOURS, tiebreak="event_id",
                                   value=_cents(), end_marker=_is_end())
    return _drained(s, "stream-sessions", path).select(
        "user_id", "session_seq", "session_start_us", "session_end_us",
        F.col("session_end_us").alias("event_time_us"), "n_events", "value_cents")


@register_stateful("stream_session_totals")
def q_stream_session_totals(spark, sf):
    """Sessions re-grouped per user into totals: two stateful operators in a
    row."""
    events, path = _events_replay(spark, sf)
    s = stream_session_totals(events, "user_id", "ts", SIX_HOURS, tiebreak="event_id",
                              value=_cents(), end_marker=_is_end())
    return _drained(s, "stream-session-totals", path)


@register_stateful("stream_sessions_late")
def q_stream_sessions_late(spark, sf):
    """Strict sessions on a stream in which every seventh event comes after
    all others: sessions of the events in time, and the late events as rows.
    (The watermark moves between micro-batches: another seventh comes in
    between.)"""
    import datetime as _dt
    m = F.col("event_id") % 7
    e = _events(spark, sf).withColumn("turn", F.when(m == 3, 2).when(m == 0, 1).otherwise(0))
    end = spark.createDataFrame(
        [(-1, _dt.datetime(9999, 12, 31), -1, _END_TYPE, 0.0, "{}", 3)], e.schema)
    path, n = write_replay_files(e, "turn", end_rows=end, bounds=[0, 1])
    s = stream_sessions_with_final(
        replay_stream(spark, path, e.schema, n), "user_id", "ts", SIX_HOURS, tiebreak="event_id",
        value=_cents(), end_marker=_is_end(), late="emit")
    t = _drained(s, "stream-sessions-late", path)
    minus = F.lit(-1).cast("bigint")
    sessions = on_time(t).select(
        F.lit("session").alias("route"), "user_id", "session_seq", "session_start_us",
        "session_end_us", "n_events", "value_cents", minus.alias("event_id"))
    late = late_only(t).select(
        F.lit("late").alias("route"), "user_id", minus.alias("session_seq"),
        F.col("late_event_us").alias("session_start_us"), minus.alias("session_end_us"),
        F.lit(1).cast("bigint").alias("n_events"), F.col("late_value").alias("value_cents"),
        F.col("late_tiebreak").alias("event_id"))
    return sessions.unionByName(late)


@register_stateful("stream_job_output_expired")
def q_stream_job_output_expired(spark, sf):
    """job_output_varied on a stream that forgets a graph after six hours
    without payloads; what it had collected comes out as incomplete."""
    events, path = _events_replay(spark, sf)
    s = stream_job_output(I.varied_payloads(events), "graphid", arrival=I.VARIED_ARRIVAL,
                          idle_seconds=SIX_HOURS, event_time="ts",
                          end_marker=F.col("event_id") == -1)
    return _drained(s, "stream-job-output-expired", path).select(
        "graphid", "fire", "n_payloads", F.array_join("outputs", "|").alias("outputs_text"),
        "complete", "first_us", "last_us")


def _stream_tagged(spark, sf):
    events, path = _events_replay(spark, sf)
    return I.tagged_branches(events.where(~_is_end())), path


@register_stateful("stream_sync_occurrence")
def q_stream_sync_occurrence(spark, sf):
    tagged, path = _stream_tagged(spark, sf)
    s = stream_sync_tagged(tagged, _N_BRANCHES, match="occurrence")
    return _occurrence_view(_drained(s, "stream-sync-occurrence", path))


@register_stateful("stream_sync_arrival")
def q_stream_sync_arrival(spark, sf):
    tagged, path = _stream_tagged(spark, sf)
    s = _drained(stream_sync_tagged(tagged, _N_BRANCHES, match="arrival"),
                 "stream-sync-arrival", path)
    return s.select("key", "group", "srcs",
                    F.array_join(F.transform("items", _item_text), "|").alias("values_text"))


@register_stateful("stream_sync_longest")
def q_stream_sync_longest(spark, sf):
    """sync_longest on a stream: incomplete rows are emitted when the end of
    stream marker moves the watermark to the end."""
    events, path = _events_replay(spark, sf)
    st = I.tagged_branches(events, keep_other=True)
    s = _drained(stream_sync_tagged(st, _N_BRANCHES, match="occurrence", mode="longest",
                                    end_marker=F.col("src").isNull()),
                 "stream-sync-longest", path)
    o = _occurrence_view(s)
    return o.select("key", "occurrence", F.col("value_0").cast("string").alias("value_0"),
                    "value_1", F.col("value_2_cents").cast("string").alias("value_2_cents"),
                    F.col("value_3_size").cast("string").alias("value_3_size"), "value_4")


# Rows of a part in which payloads are built for a replay, and parts at most.
_PART_ROWS, _MOST_PARTS = 2_000_000, 8


def _payload_replay(spark, sf, n_slices=3, consume=True):
    lineitem = I.table(spark, sf, "lineitem")
    # an order's lines are in one part: what a part shuffles is gone before the next
    parts = min(_MOST_PARTS, -(-lineitem.count() // _PART_ROWS)) or 1
    own = F.pmod(F.xxhash64("l_orderkey"), F.lit(parts))
    p = [I.payloads_from_lineitem(lineitem.where(own == k)) for k in range(parts)]
    path, n = write_replay_files(p, "arrival_ts", n_slices)
    return replay_stream(spark, path, p[0].schema, n, consume), path


@register_stateful("stream_job_output_job")
def q_stream_job_output_job(spark, sf):
    payloads, path = _payload_replay(spark, sf)
    s = stream_job_output(payloads, "jobid", arrival=I.PAYLOAD_ARRIVAL)
    return _fired_view(_drained(s, "stream-job-output-job", path), ["graphid", "jobid"])


@register_stateful("stream_job_output_graph")
def q_stream_job_output_graph(spark, sf):
    payloads, path = _payload_replay(spark, sf)
    s = stream_job_output(payloads, "graphid", arrival=I.PAYLOAD_ARRIVAL)
    return _fired_view(_drained(s, "stream-job-output-graph", path), ["graphid"])



@register("stream_user_scores_sorted")
def q_stream_user_scores_sorted(spark, sf):
    """user_scores_sorted on a stream of game lines: parsed on the stream,
    counted per (user, score) by a stateful streaming aggregation in update
    mode; the latest count of every run."""
    lines = I.game_lines(_events(spark, sf), "ts")
    path, n = write_replay_files(lines, "ts", 3)
    st = replay_stream(spark, path, lines.schema, n)
    counts = stream_group_values(parse_game_event(st), "user", "score")
    out = run_updates_to_table(counts, ["user", "score"], "stream-user-scores")
    dropped(path)
    return out


@register("stream_fixed_windows_count")
def q_stream_fixed_windows_count(spark, sf):
    """fixed_windows_count on a stream: windows appended as the watermark
    passes them."""
    events, path = _events_replay(spark, sf)
    s = stream_fixed_window_counts(events, "ts", 5, keys=["event_type"], end_marker=_is_end())
    t = _drained(s, "stream-fixed-windows", path)
    return t.select(F.unix_micros(F.col("window.start")).alias("window_start_us"),
                    "event_type", "n")


@register("word_sessions")
def q_word_sessions(spark, sf):
    """The word-count experiment over documents: first word and 'more' flag
    per line, then per-word sessions with a 30 s gap, closed by a final
    (a line with more than one word). Line time: document i at hour i, its
    lines one second apart."""
    lines = I.document_lines(I.table(spark, sf, "documents"))
    words = (first_word_more(lines, "line")
             .withColumn("et", F.timestamp_seconds(F.col("doc_id") * 3600 + F.col("line_no")))
             .withColumn("tb", F.col("doc_id") * 1_000_000 + F.col("line_no")))
    s = sessions_with_final(words, "word", "et", 30, is_final=~F.col("more"), tiebreak=["tb"])
    return s.select("word", "session_seq", _us("session_start").alias("session_start_us"),
                    _us("session_end").alias("session_end_us"), "closed", "n_events")


# --- sources and sinks --------------------------------------------------------

@register("lines_round_trip")
def q_lines_round_trip(spark, sf):
    """Total scores written as text lines and read back."""
    path = claimed_path(spark, "score-lines")
    t = total_score(_parsed(spark, sf), "user")
    write_lines(t.select(format_score(F.col("user"), F.col("total_score")).alias("text")), path,
                column="text")
    return read_lines(spark, path)


def _published(spark, sf):
    """Events published as message files: props as data, the rest attributes."""
    path = claimed_path(spark, "messages")
    e = _events(spark, sf)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    write_messages(with_attributes(e, F.col("props"), id=F.col("event_id"),
                                   event_type=F.col("event_type"), timestamp=ms), path)
    return path


@register("messages_round_trip")
def q_messages_round_trip(spark, sf):
    """Messages published with attributes, read back, event time taken from
    the ``timestamp`` attribute, data decoded."""
    msgs = read_messages(spark, _published(spark, sf), streaming=False)
    return event_time_from_attribute(msgs).select(
        F.col("attributes")["id"].cast("bigint").alias("event_id"),
        F.col("attributes")["event_type"].alias("event_type"),
        _us("event_time").alias("event_time_us"), decode_utf8(F.col("data")).alias("text"))


@register("stream_message_strings")
def q_stream_message_strings(spark, sf):
    """The data of published messages as text, read as a stream."""
    path = _published(spark, sf)
    return _drained(read_message_strings(spark, path), "stream-message-strings", path)


# --- projections with times, keys, counters -----------------------------------

@register("game_event_times")
def q_game_event_times(spark, sf):
    """Parsed events with the event time of their line."""
    return _parsed(spark, sf).select("user", "team", "score", _us("event_time").alias("time_us"))


@register("assign_event_time")
def q_assign_event_time(spark, sf):
    e = _events(spark, sf).select("event_id", F.unix_millis(F.col("ts").cast("timestamp"))
                                  .alias("ms"))
    return assign_event_time(e, millis="ms").select("event_id", _us("event_time").alias("time_us"))


@register("key_by")
def q_key_by(spark, sf):
    return key_by(_events(spark, sf), F.col("user_id") % 7).select("key", "event_id")


@register("now_iso")
def q_now_iso(spark, sf):
    form = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$"
    return _events(spark, sf).select("event_id", now_iso().rlike(form).alias("in_form"))


@register("random_value")
def q_random_value(spark, sf):
    r = _events(spark, sf).select("event_id", random_value(7).alias("r"))
    return r.select("event_id", ((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"))


@register("count_rejects")
def q_count_rejects(spark, sf):
    """Counters kept beside the data: lines, rejected lines and empty lines
    of the events' game lines and the documents' text lines."""
    game, words = Observation(), Observation()
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(parse_game_event(I.game_lines(_events(spark, sf)), observation=game))
    noop(first_word_more(I.document_lines(I.table(spark, sf, "documents")), "line",
                         observation=words))
    return spark.createDataFrame(
        [(game.get["num_lines"], game.get["num_parse_errors"], words.get["empty_lines"])],
        "num_lines bigint, num_parse_errors bigint, empty_lines bigint")


@register("dead_letter_expr")
def q_dead_letter_expr(spark, sf):
    """The dead letters of a failure that a Column can tell: no Python."""
    d = dead_letter_expr(_events(spark, sf), F.col("event_type") == "error", "ValueError",
                         "error events are not accepted")
    return errors(d).select("event_id", "error.error_class", "error.message")


@register("sync_inputs")
def q_sync_inputs(spark, sf):
    """sync_occurrence over five separate inputs."""
    return _occurrence_view(sync(I.keyed_branches(_events(spark, sf)), match="occurrence"))


@register("job_output_graph_rows")
def q_job_output_graph_rows(spark, sf):
    """The payloads of complete graphs, one row each."""
    rows = job_output_rows(_payloads(spark, sf), "graphid", arrival=I.PAYLOAD_ARRIVAL)
    return rows.select("graphid", "fire", "place", "n_payloads",
                       F.array_join("output", "|").alias("output_text"))


@register("stream_fixed_windows_late")
def q_stream_fixed_windows_late(spark, sf):
    """fixed_windows_count on a stream in which every seventh event comes
    after all others: where the watermark has closed its window it is late
    and dropped. (Spark judges lateness by the watermark of the micro-batch
    before: the events of another residue come in between.)"""
    import datetime as _dt
    m = F.col("event_id") % 7
    e = _events(spark, sf).withColumn("turn", F.when(m == 3, 2).when(m == 0, 1).otherwise(0))
    end = spark.createDataFrame(
        [(-1, _dt.datetime(9999, 12, 31), -1, _END_TYPE, 0.0, "{}", 3)], e.schema)
    path, n = write_replay_files(e, "turn", end_rows=end, bounds=[0, 1])
    s = stream_fixed_window_counts(replay_stream(spark, path, e.schema, n), "ts", 5,
                                   keys=["event_type"], end_marker=_is_end())
    t = _drained(s, "stream-fixed-windows-late", path)
    return t.select(_us("window.start").alias("window_start_us"), "event_type", "n")


# --- extension points: combiners, one-to-many functions, fan-out ----------------

class Moments:
    """Count, sum, sum of squares and the three largest of a column of cents."""

    def start(self):
        return 0, 0, 0, []

    def add(self, state, values):
        x = [v for v in values.column(0).to_pylist() if v is not None]
        return self.merge(state, (len(x), sum(x), sum(v * v for v in x), x))

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1], a[2] + b[2], sorted([*a[3], *b[3]])[-3:]

    def finish(self, state):
        n, total, squares, top = state
        return n, total, squares, ",".join(map(str, top[::-1]))


@register("combined_moments")
def q_combined_moments(spark, sf):
    """A caller's own combiner: moments and largest values per event type."""
    e = _events(spark, sf).select("event_type", _cents().alias("cents"))
    return combine_by_key(e, "event_type", ["cents"], Moments(),
                          "n bigint, total bigint, squares bigint, top string")


def long_lines(text, least):
    """``(line number, characters)`` of the lines with ``least`` or more."""
    for place, line in enumerate((text or "").split("\n")):
        if len(line) >= least:
            yield place, len(line)


@register("flat_map_lines")
def q_flat_map_lines(spark, sf):
    """A one-to-many function with an argument, over documents."""
    return flat_map(I.table(spark, sf, "documents"), long_lines, ["text"],
                    "line_no bigint, n_chars bigint", keep=["doc_id"], least=80)


@register("stream_fan_out")
def q_stream_fan_out(spark, sf):
    """Task, job and graph outputs of one stream, read once."""
    payloads, replay = _payload_replay(spark, sf, consume=False)
    path = claimed_path(spark, "fan-out")

    def level(name):
        return KeyedBranch(level_keys(name), lambda rows: ready_keys(rows, name),
                           lambda rows: job_output_and_rest(rows, name, arrival=I.PAYLOAD_ARRIVAL))

    found = run_fan_out(payloads, {
        "taskid": lambda rows: (job_output(rows, "taskid"), None),
        "jobid": level("jobid"), "graphid": level("graphid")}, path)
    dropped(replay)
    parts = [t.agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("n_rows"),
                   F.coalesce(F.sum(F.size("outputs")), F.lit(0)).cast("bigint")
                   .alias("n_outputs")) for name, t in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("stream_counters")
def q_stream_counters(spark, sf):
    """Counters of a stream of game lines, added up over its micro-batches,
    under a row budget that it keeps."""
    lines = I.game_lines(_events(spark, sf), "ts")
    replay, n = write_replay_files(lines, "ts", 3)
    parsed = parse_game_event(replay_stream(spark, replay, lines.schema, n), observation="game")
    path = claimed_path(spark, "stream-counters")
    with StreamCounters(spark, {"num_lines": lines.count()}) as counters:
        found = counters.run(parsed, lambda w: w.format("parquet").option("path", f"{path}/out")
                             .option("checkpointLocation", f"{path}/checkpoint")
                             .trigger(availableNow=True).start())
    rows = spark.read.schema(parsed.schema).parquet(f"{path}/out").count()
    dropped(replay, path)
    return spark.createDataFrame(
        [(found["num_lines"], found["num_parse_errors"], rows)],
        "num_lines bigint, num_parse_errors bigint, num_rows bigint")
