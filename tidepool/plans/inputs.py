"""Stand-in inputs built from the driver's tables.

Each builder only reshapes a table into the schema an operator expects
(text lines, messages, payloads, keyed branches); it does none of the
operator's work. Every row of the source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> "F.Column":
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def game_lines(events: DataFrame, *extra: str) -> DataFrame:
    """One CSV line per event: ``user<id>,team<id % 10>,<floor(value)>,<epoch
    ms>,<readable time>``. Lines are damaged or varied by ``event_id % 50``:
    0 empty, 1 two fields, 2 score ``n.5``, 3 score ``n_0``, 4 time ``t<ms>``
    (rejects); 5 score with spaces, 6 score with ``+``, 7 user quoted with a
    comma, 8 a quote inside an unquoted user, 9 a doubled quote inside a
    quoted one (accepted). ``extra`` columns of the events are kept beside the
    line (e.g. ``ts`` to replay the lines in time order)."""
    user = F.concat(F.lit("user"), _s("user_id"))
    team = F.concat(F.lit("team"), _s(F.col("user_id") % 10))
    score = _s(F.floor("value").cast("bigint"))
    ms = _s(F.unix_millis(F.col("ts").cast("timestamp")))
    readable = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    d = F.col("event_id") % 50

    def line(u=user, s=score, t=ms):
        return F.concat_ws(",", u, team, s, t, readable)

    value = (F.when(d == 0, F.lit(""))
              .when(d == 1, F.concat_ws(",", user, team))
              .when(d == 2, line(s=F.concat(score, F.lit(".5"))))
              .when(d == 3, line(s=F.concat(score, F.lit("_0"))))
              .when(d == 4, line(t=F.concat(F.lit("t"), ms)))
              .when(d == 5, line(s=F.concat(F.lit(" "), score, F.lit(" "))))
              .when(d == 6, line(s=F.concat(F.lit("+"), score)))
              .when(d == 7, line(u=F.concat(F.lit('"'), user, F.lit(',x"'))))
              .when(d == 8, line(u=F.concat(F.lit('us"er'), _s("user_id"))))
              .when(d == 9, line(u=F.concat(F.lit('"'), user, F.lit('""q"'))))
              .otherwise(line()))
    return events.select(value.alias("value"), *extra)


def event_time_ts(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as a zoned TIMESTAMP (the tables store NTZ; Spark's
    streaming watermark needs TIMESTAMP)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def document_lines(documents: DataFrame) -> DataFrame:
    """One row per line of every document: ``(doc_id, line_no, line)``."""
    return documents.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def messages_from_events(events: DataFrame) -> DataFrame:
    """Broker messages: ``data`` = the ``props`` JSON bytes, attributes
    ``event_type``, ``user``, ``id`` and ``timestamp`` (epoch ms),
    ``publish_time`` = ts. The data is damaged by ``event_id % 50``: 10 text
    after it, 11 twice, 12 single quotes, 13 an array, 14 cut off."""
    d = F.col("event_id") % 50
    data = (F.when(d == 10, F.concat("props", F.lit(" junk")))
             .when(d == 11, F.concat("props", "props"))
             .when(d == 12, F.replace("props", F.lit('"'), F.lit("'")))
             .when(d == 13, F.concat(F.lit("["), "props", F.lit("]")))
             .when(d == 14, F.substring("props", 1, 4))
             .otherwise(F.col("props")))
    attrs = F.create_map(
        F.lit("event_type"), F.col("event_type"),
        F.lit("user"), _s("user_id"),
        F.lit("id"), _s("event_id"),
        F.lit("timestamp"), _s(F.unix_millis(F.col("ts").cast("timestamp"))))
    return events.select(data.cast("binary").alias("data"),
                         attrs.alias("attributes"),
                         F.col("ts").cast("timestamp").alias("publish_time"))


def number_texts(events: DataFrame) -> DataFrame:
    """``(event_id, k_text)``: the number in ``props`` as text, by ``event_id
    % 50`` spelled as other languages would: 1 ``nd``, 2 ``0xn``, 3 ``n.0f``,
    4 `` n.5e1 ``, 5 ``n_0``."""
    k = F.regexp_extract("props", r":\s*(-?\d+)", 1)
    d = F.col("event_id") % 50
    return events.select("event_id", F.when(d == 1, F.concat(k, F.lit("d")))
                         .when(d == 2, F.concat(F.lit("0x"), k))
                         .when(d == 3, F.concat(k, F.lit(".0f")))
                         .when(d == 4, F.concat(F.lit(" "), k, F.lit(".5e1 ")))
                         .when(d == 5, F.concat(k, F.lit("_0"))).otherwise(k).alias("k_text"))


BRANCH_TYPES = ("click", "view", "purchase", "signup", "error")


def _branch_values():
    from tidepool.functions.scalar import value_range
    return {
        "click": F.floor("value").cast("bigint"),
        "view": _s("event_id"),
        "purchase": F.col("value"),
        "signup": value_range(F.floor("value")),
        "error": F.col("props"),
    }


def keyed_branches(events: DataFrame) -> list[DataFrame]:
    """One keyed input ``(key, value, arrival_ts, arrival_id)`` per event
    type, keyed by user, with the value types of the reference's branches:
    click -> int (floor of value), view -> string (event id), purchase ->
    double (value), signup -> list of ints (``range(floor(value))``), error
    -> string (the props text). Every event is in exactly one input."""
    base = events.select(F.col("user_id").alias("key"), "event_type", "value", "props",
                         "event_id", F.col("ts").alias("arrival_ts"),
                         F.col("event_id").alias("arrival_id"))
    values = _branch_values()
    return [base.where(F.col("event_type") == t)
                .select("key", values[t].alias("value"), "arrival_ts", "arrival_id")
            for t in BRANCH_TYPES]


def tagged_branches(events: DataFrame, keep_other: bool = False) -> DataFrame:
    """The same inputs as :func:`keyed_branches`, as one source-tagged
    DataFrame for ``sync_tagged``: one scan of the table instead of one per
    input. ``src`` is the index of the event type in ``BRANCH_TYPES``;
    ``keep_other`` keeps rows of other types with a NULL ``src`` (end of
    stream markers)."""
    values = _branch_values()
    et = F.col("event_type")
    src = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(BRANCH_TYPES))):
        src = F.when(et == t, F.lit(i)).otherwise(src)
    return (events.select(F.col("user_id").alias("key"), src.alias("src"),
                          *[F.when(et == t, values[t]).alias(f"value_{i}")
                            for i, t in enumerate(BRANCH_TYPES)],
                          F.col("ts").alias("arrival_ts"), F.col("event_id").alias("arrival_id"))
                  .where(F.lit(keep_other) | F.col("src").isNotNull()))


def payloads_from_lineitem(lineitem: DataFrame, outputs: int = 2) -> DataFrame:
    """Work payloads: an order is a graph, its line statuses (F -> job 0,
    O -> job 1) are jobs, its lines are tasks. A job declares as many tasks
    as its highest line number; ``jobtasks`` maps every job of the graph to
    that count. Each payload writes ``outputs`` paths. Arrival order:
    ``(l_shipdate, l_linenumber, l_partkey, l_suppkey)`` plus the remaining
    columns as tiebreaks."""
    job = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    li = lineitem.withColumn("jobid", job.cast("bigint"))
    # Declared task counts: an aggregate (partial maxima map-side) with one row
    # per order and an entry for each of its jobs, joined back on the order key
    # (AQE splits a hot order's partition on the lineitem side). Every order has
    # its row, so a left join gives the same rows - and lets Catalyst drop the
    # join from plans that read no declared column.
    jobs = [(str(j), F.col("jobid") == j) for j in (0, 1)]
    entries = F.array(*[F.when(F.col(f"_has_{j}"), F.struct(F.lit(j).alias("jobid"), F.col(
        f"_ntasks_{j}").alias("_ntasks"))) for j, _ in jobs])
    declared = li.groupBy("l_orderkey").agg(
        *[F.max(F.when(own, F.col("l_linenumber"))).alias(f"_ntasks_{j}") for j, own in jobs],
        *[F.max(own).alias(f"_has_{j}") for j, own in jobs]).select(
        "l_orderkey", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull()))
        .alias("jobtasks"))
    li = li.join(declared, "l_orderkey", "left")
    graph = F.col("l_orderkey")
    task = F.col("l_linenumber")
    # fixed value: the form of an output path
    out = F.transform(F.sequence(F.lit(0), F.lit(outputs - 1)), lambda i: F.concat(
        F.lit("/beam/graph-"), _s(graph), F.lit("/job-"), _s("jobid"),
        F.lit("_output-"), _s(i), F.lit(".task-"), _s(task), F.lit(".ext")))
    return li.select(
        graph.cast("bigint").alias("graphid"), "jobtasks", "jobid",
        task.cast("bigint").alias("taskid"), out.alias("output"),
        F.col("l_shipdate").alias("arrival_ts"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")


PAYLOAD_ARRIVAL = ["arrival_ts", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def varied_payloads(events: DataFrame) -> DataFrame:
    """Work payloads whose declared numbers change: a user is a graph of one
    job, event i declares ``1 + i % 4`` parts and writes its id. Arrival order:
    ``(ts, event_id)``."""
    parts = (F.col("event_id") % 4 + 1).cast("int")
    return events.select(
        F.col("user_id").alias("graphid"), F.create_map(F.lit("0"), parts).alias("jobtasks"),
        F.lit(0).cast("bigint").alias("jobid"), F.col("event_id").alias("taskid"),
        F.array(F.col("event_id").cast("string")).alias("output"), "ts", "event_id")


VARIED_ARRIVAL = ["ts", "event_id"]


def variable_windows(events: DataFrame) -> DataFrame:
    """Events with a window of their own: 10 minutes times 1 to 36, from the
    event's time on."""
    length = F.make_dt_interval(mins=(F.col("event_id") % 36 + 1) * 10)
    return events.withColumns({"window_from": F.col("ts"), "window_to": F.col("ts") + length})
