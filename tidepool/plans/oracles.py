"""DuckDB SQL oracles, one per registered query (same column names).

They compute the expected result independently, straight from the driver's
tables: where a query parses stand-in lines, the oracle works from the
events the lines were made of.
"""

from __future__ import annotations

# Event rows as the game lines carry them (see plans.inputs.game_lines):
# d = event_id % 50 picks the damaged variants; 0-4 are rejects.
_GAME = """
  (SELECT event_id, user_id, ts, value, event_id % 50 AS d,
          CAST(floor(value) AS BIGINT) AS score,
          CASE event_id % 50 WHEN 8 THEN 'us"er' ELSE 'user' END || CAST(user_id AS VARCHAR) ||
            CASE event_id % 50 WHEN 7 THEN ',x' WHEN 9 THEN '"q' ELSE '' END AS "user",
          'team' || CAST(user_id % 10 AS VARCHAR) AS team
   FROM events)
"""
_ACCEPTED = f"(SELECT * FROM {_GAME} g WHERE d NOT IN (0, 1, 2, 3, 4))"

_LINE = """concat_ws(',', 'user' || CAST(user_id AS VARCHAR), 'team' || CAST(user_id % 10 AS VARCHAR),
    {score}, {ms}, strftime(ts, '%Y-%m-%d %H:%M:%S.%g'))"""
_S = "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"
_MS = "CAST(epoch_us(ts) // 1000 AS VARCHAR)"

_SIX_H_US = 6 * 3600 * 1_000_000

_STRICT_SESSIONS = f"""
  (WITH o AS (
     SELECT user_id, ts, event_id, value,
            lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt
     FROM events),
   b AS (
      SELECT *, CAST(sum(CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) >= {_SIX_H_US}
                        THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_seq
     FROM o)
   SELECT user_id, session_seq,
          epoch_us(min(ts)) AS session_start_us,
          epoch_us(max(ts)) + {_SIX_H_US} AS session_end_us,
          epoch_us(max(ts)) + {_SIX_H_US} AS event_time_us,
          count(*) AS n_events,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
   FROM b GROUP BY user_id, session_seq)
"""

# Python's whitespace, spelled out as in tidepool.functions.parse.WS_CLASS.
_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

_DOC_WORDS = f"""
  (SELECT list_filter(string_split_regex(
              regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+'),
              lambda x: x <> '') AS words
   FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
"""


_OCC = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS occ"
_SYNC_BRANCHES = f"""
        WITH c AS (SELECT user_id AS key, CAST(floor(value) AS BIGINT) AS v, {_OCC}
                   FROM events WHERE event_type = 'click'),
             v AS (SELECT user_id AS key, CAST(event_id AS VARCHAR) AS v, {_OCC}
                   FROM events WHERE event_type = 'view'),
             p AS (SELECT user_id AS key, CAST(round(value * 100) AS BIGINT) AS v, {_OCC}
                   FROM events WHERE event_type = 'purchase'),
             s AS (SELECT user_id AS key, greatest(CAST(floor(value) AS BIGINT), 0) AS v, {_OCC}
                   FROM events WHERE event_type = 'signup'),
             e AS (SELECT user_id AS key, props AS v, {_OCC}
                   FROM events WHERE event_type = 'error')"""

_PATHS = " || '|' || ".join(
    "'/beam/graph-' || CAST(li.l_orderkey AS VARCHAR) || '/job-' || CAST(li.jobid AS VARCHAR)"
    f" || '_output-{i}.task-' || CAST(li.l_linenumber AS VARCHAR) || '.ext'" for i in range(2))

_ARRIVAL = ("l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
            "l_discount, l_tax, l_returnflag")


def _fired(keys: str, expected: str, join: str, select_keys: str) -> str:
    """Completion in SQL: payloads numbered per key in arrival order, cut
    into groups of the declared size; complete groups fire."""
    return f"""
        WITH li AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS jobid FROM lineitem),
        dj AS (SELECT l_orderkey, jobid, max(l_linenumber) AS nt FROM li GROUP BY 1, 2),
        dg AS (SELECT l_orderkey, sum(nt) AS expected FROM dj GROUP BY 1),
        p AS (SELECT li.l_orderkey, li.jobid, {expected} AS expected, {_PATHS} AS paths,
                     row_number() OVER (PARTITION BY {", ".join("li." + k.strip() for k in keys.split(","))}
                                        ORDER BY {", ".join("li." + c.strip() for c in _ARRIVAL.split(","))}) AS rn
              FROM li JOIN {join}),
        g AS (SELECT {keys}, CAST((rn - 1) // expected + 1 AS BIGINT) AS fire, count(*) AS n,
                     max(expected) AS expected, string_agg(paths, '|' ORDER BY rn) AS outputs_text
              FROM p GROUP BY {keys}, fire)
        SELECT {select_keys}, fire, n AS n_payloads, CAST(2 * n AS BIGINT) AS n_outputs, outputs_text
        FROM g WHERE n = expected"""


ORACLES: dict[str, str] = {
    "user_scores_sorted": f"""
        SELECT "user", score, count(*) AS n FROM {_ACCEPTED} a GROUP BY "user", score""",
    "team_scores_sorted": f"""
        SELECT team, score, count(*) AS n FROM {_ACCEPTED} a GROUP BY team, score""",
    "user_total_score": f"""
        SELECT "user", CAST(sum(score) AS BIGINT) AS total_score FROM {_ACCEPTED} a GROUP BY "user" """,
    "team_total_score": f"""
        SELECT team, CAST(sum(score) AS BIGINT) AS total_score FROM {_ACCEPTED} a GROUP BY team""",
    "score_text": f"""
        SELECT "user", 'user: ' || "user" || ', total_score: ' || CAST(sum(score) AS VARCHAR) AS text
        FROM {_ACCEPTED} a GROUP BY "user" """,
    "parse_rejects": f"""
        SELECT CASE d
                 WHEN 0 THEN ''
                 WHEN 1 THEN 'user' || CAST(user_id AS VARCHAR) || ',team' || CAST(user_id % 10 AS VARCHAR)
                 WHEN 2 THEN {_LINE.format(score=_S + " || '.5'", ms=_MS)}
                 WHEN 3 THEN {_LINE.format(score=_S + " || '_0'", ms=_MS)}
                 ELSE {_LINE.format(score=_S, ms="'t' || " + _MS)}
               END AS value,
               CASE WHEN d IN (0, 1) THEN 'too_few_fields'
                    WHEN d IN (2, 3) THEN 'bad_score' ELSE 'bad_time' END AS reason
        FROM {_GAME} g WHERE d IN (0, 1, 2, 3, 4)""",
    "parse_reject_counts": f"""
        SELECT CASE WHEN d IN (0, 1) THEN 'too_few_fields'
                    WHEN d IN (2, 3) THEN 'bad_score' ELSE 'bad_time' END AS reason,
               count(*) AS n
        FROM {_GAME} g WHERE d IN (0, 1, 2, 3, 4) GROUP BY 1""",
    "sessions_strict": f"SELECT * FROM {_STRICT_SESSIONS} s",
    "sessions_to_global": f"""
        SELECT user_id, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events,
               max(n_events) AS longest_session, CAST(sum(value_cents) AS BIGINT) AS value_cents
        FROM {_STRICT_SESSIONS} s GROUP BY user_id""",
    "sessions_with_final": f"""
        WITH o AS (
          SELECT user_id, ts, event_id, event_type = 'purchase' AS fin,
                 lag(ts) OVER w AS pt, lag(event_type = 'purchase') OVER w AS pf
          FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id)),
        b AS (
          SELECT *, CAST(sum(CASE WHEN pt IS NULL OR pf
                               OR epoch_us(ts) - epoch_us(pt) >= {_SIX_H_US}
                             THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, fin, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_seq
          FROM o)
        SELECT user_id, session_seq, epoch_us(min(ts)) AS session_start_us,
               CASE WHEN bool_or(fin) THEN epoch_us(max(ts))
                    ELSE epoch_us(max(ts)) + {_SIX_H_US} END AS session_end_us,
               bool_or(fin) AS closed, count(*) AS n_events
        FROM b GROUP BY user_id, session_seq""",
    "fixed_windows_count": """
        SELECT epoch_us(time_bucket(INTERVAL 5 SECOND, ts)) AS window_start_us,
               event_type, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "first_word_more": f"""
        SELECT words[1] AS word, len(words) = 1 AS more, count(*) AS n
        FROM {_DOC_WORDS} w WHERE len(words) > 0 GROUP BY 1, 2""",
    "sync_occurrence": f"""
        {_SYNC_BRANCHES}
        SELECT c.key AS key, c.occ AS occurrence, c.v AS value_0, v.v AS value_1,
               p.v AS value_2_cents, s.v AS value_3_size, e.v AS value_4
        FROM c JOIN v ON c.key = v.key AND c.occ = v.occ
               JOIN p ON c.key = p.key AND c.occ = p.occ
               JOIN s ON c.key = s.key AND c.occ = s.occ
               JOIN e ON c.key = e.key AND c.occ = e.occ""",
    "sync_longest": f"""
        {_SYNC_BRANCHES}
        SELECT coalesce(c.key, v.key, p.key, s.key, e.key) AS key,
               coalesce(c.occ, v.occ, p.occ, s.occ, e.occ) AS occurrence,
               CAST(c.v AS VARCHAR) AS value_0, v.v AS value_1, CAST(p.v AS VARCHAR) AS value_2_cents,
               CAST(s.v AS VARCHAR) AS value_3_size, e.v AS value_4
        FROM c FULL JOIN v ON c.key = v.key AND c.occ = v.occ
               FULL JOIN p ON p.key = coalesce(c.key, v.key) AND p.occ = coalesce(c.occ, v.occ)
               FULL JOIN s ON s.key = coalesce(c.key, v.key, p.key)
                          AND s.occ = coalesce(c.occ, v.occ, p.occ)
               FULL JOIN e ON e.key = coalesce(c.key, v.key, p.key, s.key)
                          AND e.occ = coalesce(c.occ, v.occ, p.occ, s.occ)""",
    "sync_arrival": """
        WITH u AS (
          SELECT user_id AS key, ts, event_id,
                 CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
                                 WHEN 'signup' THEN 3 ELSE 4 END AS src,
                 CASE event_type
                   WHEN 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
                   WHEN 'view' THEN CAST(event_id AS VARCHAR)
                   WHEN 'purchase' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
                   WHEN 'signup' THEN 'r' || CAST(greatest(CAST(floor(value) AS BIGINT), 0) AS VARCHAR)
                   ELSE props END AS vt
          FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id, src) AS rn FROM u),
        g AS (SELECT key, (rn - 1) // 5 + 1 AS "group", count(*) AS n,
                     string_agg(CAST(src AS VARCHAR), ',' ORDER BY rn) AS srcs,
                     string_agg(vt, '|' ORDER BY rn) AS values_text
              FROM n GROUP BY 1, 2)
        SELECT key, "group", srcs, values_text FROM g WHERE n = 5""",
    "flatten_union": """
        SELECT event_id, event_type FROM events WHERE value < 100
        UNION ALL
        SELECT event_id, event_type FROM events WHERE event_type = 'view'""",
    "job_output_task": """
        SELECT CAST(l_orderkey AS BIGINT) AS graphid,
               CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS jobid,
               count(*) AS n_tasks, CAST(2 * count(*) AS BIGINT) AS n_outputs
        FROM lineitem GROUP BY 1, 2""",
    "job_output_job": _fired("l_orderkey, jobid", "dj.nt",
                             "dj ON li.l_orderkey = dj.l_orderkey AND li.jobid = dj.jobid",
                             "CAST(l_orderkey AS BIGINT) AS graphid, CAST(jobid AS BIGINT) AS jobid"),
    "job_output_graph": _fired("l_orderkey", "dg.expected", "dg ON li.l_orderkey = dg.l_orderkey",
                               "CAST(l_orderkey AS BIGINT) AS graphid"),
    "job_output_all_levels": f"""
        SELECT 'taskid' AS level, count(*) AS n_rows, CAST(2 * count(*) AS BIGINT) AS n_outputs
        FROM lineitem
        UNION ALL
        SELECT 'jobid', count(*), CAST(sum(n_outputs) AS BIGINT) FROM ({_fired("l_orderkey, jobid", "dj.nt",
                             "dj ON li.l_orderkey = dj.l_orderkey AND li.jobid = dj.jobid",
                             "l_orderkey, jobid")}) a
        UNION ALL
        SELECT 'graphid', count(*), CAST(sum(n_outputs) AS BIGINT) FROM ({_fired("l_orderkey", "dg.expected",
                             "dg ON li.l_orderkey = dg.l_orderkey", "l_orderkey")}) b""",
    "filter_attributes": """
        SELECT event_id, CASE WHEN event_id % 50 NOT IN (10, 11, 12, 13, 14) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k
        FROM events WHERE event_type = 'purchase'""",
    "filter_attributes_list": """
        SELECT event_id, CASE WHEN event_id % 50 NOT IN (10, 11, 12, 13, 14) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k
        FROM events WHERE event_type = 'view'""",
    "filter_attributes_chars": """
        SELECT event_id, CASE WHEN event_id % 50 NOT IN (10, 11, 12, 13, 14) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k
        FROM events WHERE list_has_all(string_split(event_type, ''), ['k', 'c', 'i', 'l'])""",
    "decode_all_messages": """
        SELECT event_id, CASE WHEN event_id % 50 NOT IN (10, 11, 12, 13, 14) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""",
    "split_threshold": """
        SELECT event_id, CASE WHEN value < 50.0 THEN 'lower' ELSE 'upper' END AS route
        FROM events""",
    "dead_letter": """
        SELECT event_id, 'ValueError' AS error_class, 'error events are not accepted' AS message
        FROM events WHERE event_type = 'error'""",
    "dead_letter_main": """
        SELECT event_id, event_type = 'error' AS failed FROM events""",
    "fail_on_value": "SELECT event_id, value FROM events",
    "row_budget_guard": "SELECT event_id, user_id FROM events",
    "tap_events": "SELECT event_id, event_type FROM events",
    "split_tokens": f"""
        SELECT token, count(*) AS n FROM (
          SELECT unnest(list_filter(string_split_regex(
              regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+'),
              lambda x: x <> '')) AS token FROM documents) t
        GROUP BY token""",
    "value_range": """
        SELECT event_id, greatest(CAST(floor(value) AS BIGINT), 0) AS range_size,
               CASE WHEN floor(value) > 0
                    THEN CAST(floor(value) AS BIGINT) * (CAST(floor(value) AS BIGINT) - 1) // 2
                    ELSE 0 END AS range_sum
        FROM events""",
    "multiply": "SELECT event_id, event_id * 3 AS tripled FROM events",
    "path_join": """
        SELECT event_id, list_reduce(
            ['/beam', 'user-' || CAST(user_id AS VARCHAR),
             CASE WHEN event_type = 'error' THEN '/errors' ELSE event_type END,
             CAST(event_id AS VARCHAR) || '.ext'],
            lambda acc, x: CASE WHEN starts_with(x, '/') THEN x
                                WHEN acc = '' OR ends_with(acc, '/') THEN acc || x
                                ELSE acc || '/' || x END) AS path
        FROM events""",
    "cast_branches": r"""
        SELECT event_id,
               CASE WHEN regexp_full_match(k_text, '\s*[+-]?[0-9]+\s*')
                    THEN TRY_CAST(k_text AS BIGINT) END AS as_int,
               k_text AS as_str,
               CAST(round(CASE WHEN event_id % 50 NOT IN (1, 2, 3, 5)
                 THEN TRY_CAST(trim(k_text) AS DOUBLE) END * 100) AS BIGINT) AS as_float_cents
        FROM (SELECT event_id, CASE event_id % 50 WHEN 1 THEN k || 'd' WHEN 2 THEN '0x' || k
                WHEN 3 THEN k || '.0f' WHEN 4 THEN ' ' || k || '.5e1 ' WHEN 5 THEN k || '_0'
                ELSE k END AS k_text
              FROM (SELECT event_id, regexp_extract(props, ':\s*(-?\d+)', 1) AS k FROM events)) e""",
    "encode_decode": """
        SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS roundtrip
        FROM documents""",
    "word_count_text": f"""
        SELECT words[1] AS word, words[1] || ': ' || CAST(count(*) AS VARCHAR) AS text
        FROM {_DOC_WORDS} w WHERE len(words) > 0 GROUP BY 1""",
    "timestamp_text": """
        SELECT event_id,
               CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS text,
               false AS is_end
        FROM events""",
}

ORACLES["word_sessions"] = f"""
    WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents),
    l AS (SELECT doc_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line FROM a),
    w AS (SELECT doc_id, line_no,
                 list_filter(string_split_regex(
                     regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+'),
                     lambda x: x <> '') AS words
          FROM l),
    o AS (SELECT words[1] AS word, len(words) <> 1 AS fin,
                 (doc_id * 3600 + line_no) * 1000000 AS t, doc_id * 1000000 + line_no AS tb
          FROM w WHERE len(words) > 0),
    g AS (SELECT *, lag(t) OVER x AS pt, lag(fin) OVER x AS pf FROM o
          WINDOW x AS (PARTITION BY word ORDER BY t, fin, tb)),
    b AS (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR pf OR t - pt >= 30000000 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY word ORDER BY t, fin, tb
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_seq
          FROM g)
    SELECT word, session_seq, min(t) AS session_start_us,
           CASE WHEN bool_or(fin) THEN max(t) ELSE max(t) + 30000000 END AS session_end_us,
           bool_or(fin) AS closed, count(*) AS n_events
    FROM b GROUP BY word, session_seq"""

# Streaming twins are checked against the SQL of their batch twins.
for _stream, _batch in {"stream_final_sessions": "sessions_with_final",
                        "stream_sessions": "sessions_strict",
                        "stream_session_totals": "sessions_to_global",
                        "stream_sync_occurrence": "sync_occurrence",
                        "stream_sync_arrival": "sync_arrival",
                        "stream_sync_longest": "sync_longest",
                        "stream_user_scores_sorted": "user_scores_sorted",
                        "stream_fixed_windows_count": "fixed_windows_count",
                        "stream_job_output_job": "job_output_job",
                        "stream_job_output_graph": "job_output_graph"}.items():
    ORACLES[_stream] = ORACLES[_batch]


ORACLES["lines_round_trip"] = f"SELECT text AS value FROM ({ORACLES['score_text']}) s"
ORACLES["messages_round_trip"] = """
    SELECT event_id, event_type, epoch_us(ts) // 1000 * 1000 AS event_time_us, props AS text
    FROM events"""
ORACLES["stream_message_strings"] = "SELECT props AS value FROM events"
ORACLES["game_event_times"] = f"""
    SELECT "user", team, score, epoch_us(ts) // 1000 * 1000 AS time_us FROM {_ACCEPTED} a"""
ORACLES["assign_event_time"] = """
    SELECT event_id, epoch_us(ts) // 1000 * 1000 AS time_us FROM events"""
ORACLES["key_by"] = "SELECT user_id % 7 AS key, event_id FROM events"
ORACLES["now_iso"] = "SELECT event_id, true AS in_form FROM events"
ORACLES["random_value"] = "SELECT event_id, true AS in_range FROM events"
ORACLES["count_rejects"] = f"""
    SELECT (SELECT count(*) FROM events) AS num_lines,
      (SELECT count(*) FROM events WHERE event_id % 50 < 5) AS num_parse_errors,
      (SELECT count(*) FROM {_DOC_WORDS} w WHERE len(words) = 0) AS empty_lines"""
ORACLES["dead_letter_expr"] = ORACLES["dead_letter"]
ORACLES["sync_inputs"] = ORACLES["sync_occurrence"]
ORACLES["job_output_graph_rows"] = f"""
    WITH li AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS jobid FROM lineitem),
    dj AS (SELECT l_orderkey, jobid, max(l_linenumber) AS nt FROM li GROUP BY 1, 2),
    dg AS (SELECT l_orderkey, CAST(sum(nt) AS BIGINT) AS expected FROM dj GROUP BY 1),
    p AS (SELECT li.l_orderkey, expected, {_PATHS} AS paths,
            row_number() OVER (PARTITION BY li.l_orderkey ORDER BY {_ARRIVAL}) AS rn,
            count(*) OVER (PARTITION BY li.l_orderkey) AS total
          FROM li JOIN dg ON li.l_orderkey = dg.l_orderkey)
    SELECT l_orderkey AS graphid, (rn - 1) // expected + 1 AS fire,
      (rn - 1) % expected + 1 AS place, expected AS n_payloads, paths AS output_text
    FROM p WHERE ((rn - 1) // expected + 1) * expected <= total"""
# the watermark is the latest event of the first slice, in whole milliseconds
ORACLES["stream_fixed_windows_late"] = """
    WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 5 SECOND, ts)) AS window_start_us, event_type,
                      event_id % 7 = 3 AS late FROM events),
    m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 AS mark FROM events
          WHERE event_id % 7 NOT IN (0, 3))
    SELECT window_start_us, event_type, count(*) AS n FROM w, m
    WHERE NOT late OR window_start_us + 5000000 > mark GROUP BY 1, 2"""

# state 0: no session, 1: open, 2: absorbing; one row of every user per step
ORACLES["sessions_absorb"] = f"""
    WITH RECURSIVE o AS (
      SELECT user_id, epoch_us(ts) AS t, event_type = 'purchase' AS fin,
        row_number() OVER (PARTITION BY user_id
                           ORDER BY ts, event_type = 'purchase', event_id) AS rn FROM events),
    f AS (
      SELECT user_id, rn, t, fin, CAST(1 AS BIGINT) AS seq, true AS begins,
        CASE WHEN fin THEN 2 ELSE 1 END AS state FROM o WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, t, fin, CASE WHEN idle THEN seq + 1 ELSE seq END, idle,
        CASE WHEN idle AND fin THEN 2 WHEN idle THEN 1 WHEN fin THEN 0 ELSE state END
      FROM (SELECT o.user_id, o.rn, o.t, o.fin, f.seq, f.state,
              f.state = 0 OR (f.state = 1 AND o.t - f.t >= {_SIX_H_US}) AS idle
            FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
    SELECT user_id, seq AS session_seq, min(t) AS session_start_us,
      CASE WHEN bool_or(fin AND NOT begins) THEN max(t) WHEN bool_or(fin) THEN -1
           ELSE max(t) + {_SIX_H_US} END AS session_end_us,
      bool_or(fin AND NOT begins) AS closed, count(*) AS n_events
    FROM f GROUP BY user_id, seq"""


ORACLES["job_output_varied"] = """
    WITH RECURSIVE n AS (
      SELECT user_id, event_id, 1 + event_id % 4 AS e,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    links AS MATERIALIZED (
      SELECT user_id, rn - e AS s, min(rn) AS r FROM n WHERE rn >= e GROUP BY 1, 2),
    chain AS (
      SELECT user_id, s, r, 1 AS fire FROM links WHERE s = 0
      UNION ALL SELECT l.user_id, l.s, l.r, fire + 1
      FROM chain c JOIN links l ON l.user_id = c.user_id AND l.s = c.r)
    SELECT c.user_id AS graphid, CAST(fire AS BIGINT) AS fire, r - s AS n_payloads,
      count(*) AS n_outputs, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY rn) AS outputs_text
    FROM chain c JOIN n ON n.user_id = c.user_id AND rn > s AND rn <= r
    GROUP BY c.user_id, fire, r, s"""

ORACLES["merged_windows"] = """
    WITH w AS (SELECT user_id, value, epoch_us(ts) AS s,
        epoch_us(ts) + (event_id % 36 + 1) * 600000000 AS e FROM events),
    b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
    n AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS BIGINT) AS window_seq FROM b)
    SELECT user_id, window_seq, min(s) AS window_start_us, max(e) AS window_end_us,
      count(*) AS n_events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
    FROM n GROUP BY user_id, window_seq"""

# The first micro-batch holds events of other residues than 0 and 3, the
# second those of residue 0; events of residue 3 meet what the watermark of
# the first (in whole milliseconds) has let through.
ORACLES["stream_sessions_late"] = f"""
    WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t,
        CAST(round(value * 100) AS BIGINT) AS cents, event_id % 7 AS m FROM events),
    wm AS (SELECT max(t) // 1000 * 1000 AS w FROM e WHERE m NOT IN (0, 3)),
    done AS (SELECT user_id, CASE WHEN max(t) + {_SIX_H_US} <= max(w) THEN max(t) + {_SIX_H_US}
        ELSE max(t) END AS upto FROM e, wm WHERE m <> 3 AND t <= w GROUP BY user_id),
    r AS (SELECT e.*, m = 3 AND t < coalesce(upto, t) AS late FROM e LEFT JOIN done USING (user_id)),
    o AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pt
        FROM r WHERE NOT late),
    s AS (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR t - pt >= {_SIX_H_US} THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY t, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_seq FROM o)
    SELECT 'session' AS route, user_id, session_seq, min(t) AS session_start_us,
      max(t) + {_SIX_H_US} AS session_end_us, count(*) AS n_events,
      CAST(sum(cents) AS BIGINT) AS value_cents, CAST(-1 AS BIGINT) AS event_id
    FROM s GROUP BY user_id, session_seq
    UNION ALL
    SELECT 'late', user_id, -1, t, -1, 1, cents, event_id FROM r WHERE late"""

ORACLES["stream_job_output_expired"] = f"""
    WITH RECURSIVE o AS (
      SELECT user_id, event_id, epoch_us(ts) AS t, 1 + event_id % 4 AS e,
        lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events),
    g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt >= {_SIX_H_US} THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY t, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY t, event_id)
      AS rn FROM g),
    links AS MATERIALIZED (
      SELECT user_id, k, rn - e AS s, min(rn) AS r FROM n WHERE rn >= e GROUP BY 1, 2, 3),
    chain AS (
      SELECT user_id, k, s, r, 1 AS fire FROM links WHERE s = 0
      UNION ALL SELECT l.user_id, l.k, l.s, l.r, fire + 1
      FROM chain c JOIN links l ON l.user_id = c.user_id AND l.k = c.k AND l.s = c.r),
    stop AS (SELECT user_id, k, max(r) AS r, max(fire) AS f FROM chain GROUP BY 1, 2),
    parts AS (
      SELECT c.user_id, c.k, c.fire, true AS complete, n.t, n.event_id, n.rn
      FROM chain c JOIN n ON n.user_id = c.user_id AND n.k = c.k AND rn > s AND rn <= c.r
      UNION ALL
      SELECT n.user_id, n.k, coalesce(f, 0) + 1, false, n.t, n.event_id, n.rn
      FROM n LEFT JOIN stop ON stop.user_id = n.user_id AND stop.k = n.k
      WHERE rn > coalesce(r, 0))
    SELECT user_id AS graphid, CAST(fire AS BIGINT) AS fire, count(*) AS n_payloads,
      string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY rn) AS outputs_text, complete,
      min(t) AS first_us, max(t) AS last_us
    FROM parts GROUP BY user_id, k, fire, complete"""

ORACLES["combined_moments"] = """
    WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC) AS place FROM e)
    SELECT event_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS total,
      CAST(sum(c * c) AS BIGINT) AS squares,
      string_agg(CAST(c AS VARCHAR), ',' ORDER BY place) FILTER (place <= 3) AS top
    FROM r GROUP BY event_type"""

ORACLES["flat_map_lines"] = """
    SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS n_chars FROM (
      SELECT doc_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents))
    WHERE length(line) >= 80"""

ORACLES["stream_fan_out"] = ORACLES["job_output_all_levels"]

ORACLES["stream_counters"] = f"""
    SELECT count(*) AS num_lines, count(*) FILTER (d IN (0, 1, 2, 3, 4)) AS num_parse_errors,
      count(*) FILTER (d NOT IN (0, 1, 2, 3, 4)) AS num_rows FROM {_GAME} g"""
