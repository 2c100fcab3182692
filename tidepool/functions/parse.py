"""Parsers: CSV game events, word lines, JSON payloads.

All parsing is done with Spark SQL expressions (``from_csv``, ``try_cast``,
``from_json``); a row that fails is never an exception in a task but a NULL
that routes it to the reject side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import require_columns

# Largest millisecond count whose microsecond value fits in a TIMESTAMP.
_MAX_MS = 9_223_372_036_854_775
_CSV4 = "f0 STRING, f1 STRING, f2 STRING, f3 STRING"


# Quotes inside a quoted field are doubled, a backslash is a character.
_CSV_OPTIONS = {"escape": '"'}


def _csv_fields(line: Column) -> Column:
    """The first four CSV fields; NULL for those the line does not have."""
    return F.from_csv(line, _CSV4, _CSV_OPTIONS)


def _game_event_struct(r: Column, line: Column) -> Column:
    score = r["f2"].try_cast("bigint")
    ms = r["f3"].try_cast("bigint")
    ms_ok = ms.isNotNull() & (F.abs(ms) <= F.lit(_MAX_MS))
    # an empty field reads as NULL like a missing one: a line whose fields 3
    # and 4 are empty has the commas for them
    enough = r["f3"].isNotNull() | (F.length(F.regexp_replace(
        F.when(line.contains('"'), F.regexp_replace(line, r'"[^"]*"', "")).otherwise(line),
        "[^,]", "")) >= 3)
    reason = (F.when(line.isNull() | ~enough, F.lit("too_few_fields"))
               .when(score.isNull(), F.lit("bad_score"))
               .when(~ms_ok, F.lit("bad_time")))
    return F.struct(
        F.coalesce(r["f0"], F.lit("")).alias("user"),
        F.coalesce(r["f1"], F.lit("")).alias("team"),
        score.alias("score"),
        F.when(ms_ok, F.timestamp_millis(ms)).alias("event_time"),
        reason.alias("reason"),
    )


def game_event_fields(line: Column) -> Column:
    """Parse ``user,team,score,epoch_ms[,readable_time]`` into a struct.

    Fields: user, team, score (BIGINT), event_time (TIMESTAMP), reason
    (NULL when the line is accepted, else ``too_few_fields`` / ``bad_score``
    / ``bad_time``, the first failure in field order). Quoted fields may
    contain commas; integers may carry surrounding whitespace and a sign;
    anything else (``1.5``, ``1_0``, overflow) is a reject. Fields past the
    fourth are ignored.
    """
    return _game_event_struct(_csv_fields(line), line)


def _parsed_events(lines: DataFrame, line: str) -> DataFrame:
    """``(user, team, score, event_time, reason)`` with the CSV parsed once
    per line. The parse is a projection of its own, and the fields leave
    through a generator: without that the optimizer copies the line and the
    parse into every later filter predicate that reads a field."""
    parsed = lines.select(F.col(line).alias("_line"), _csv_fields(F.col(line)).alias("_r"))
    return parsed.select(F.inline(F.array(_game_event_struct(F.col("_r"), F.col("_line")))))


def parse_game_event(lines: DataFrame, line: str = "value",
                     observation: Observation | str | None = None) -> DataFrame:
    """Accepted game events ``(user, team, score, event_time)``.

    Rejected lines are dropped; pass an ``Observation`` - on a stream a name,
    see ``StreamCounters`` - to count them (metric ``num_parse_errors``)
    beside the data.
    """
    require_columns(lines, line, where="parse_game_event")
    parsed = _parsed_events(lines, line)
    if observation is not None:
        parsed = parsed.observe(
            observation,
            F.count(F.lit(1)).alias("num_lines"),
            F.count_if(F.col("reason").isNotNull()).alias("num_parse_errors"))
    return parsed.where(F.col("reason").isNull()).drop("reason")


def game_event_rejects(lines: DataFrame, line: str = "value") -> DataFrame:
    """The rejected lines with the reason: ``(value, reason)``."""
    require_columns(lines, line, where="game_event_rejects")
    parsed = lines.select(F.col(line).alias("_line"), _csv_fields(F.col(line)).alias("_r"))
    out = parsed.select(F.col("_line").alias("value"), F.inline(F.array(F.struct(
        _game_event_struct(F.col("_r"), F.col("_line"))["reason"].alias("reason")))))
    return out.where(F.col("reason").isNotNull())


# The characters Python's str.split() / str.strip() treat as
# whitespace: \t \n \v \f \r, U+001C-U+001F, space, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# WS_CLASS spells them out for any regex engine (the SQL oracles use it);
# Spark uses the equal Java class: Java's whitespace property plus the four
# characters it leaves out (U+0085, U+00A0, U+2007, U+202F), which is about
# twice as fast.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_WS = r"[\p{javaWhitespace}\x{85}\x{A0}\x{2007}\x{202F}]"
_NON_WS = r"[^\p{javaWhitespace}\x{85}\x{A0}\x{2007}\x{202F}]"


def strip_ws(text: Column) -> Column:
    """``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(text, rf"^{_WS}++|{_WS}++$", "")


def split_ws(text: Column) -> Column:
    """``str.split()``: tokens separated by runs of whitespace, none empty."""
    return F.filter(F.split(text, rf"{_WS}++"), lambda x: x != F.lit(""))


def first_word(text: Column) -> Column:
    """``str.split()[0]``, or ``''`` when the text has no word."""
    return F.regexp_extract(text, rf"^{_WS}*+({_NON_WS}++)", 1)


def is_single_word(text: Column) -> Column:
    """``len(str.split()) == 1``."""
    return text.rlike(rf"^{_WS}*+{_NON_WS}++{_WS}*+$")


def first_word_more(lines: DataFrame, line: str = "line",
                    observation: Observation | None = None) -> DataFrame:
    """``(word, more)`` per line: the first word, and whether it is the
    line's only word. Empty (whitespace-only) lines are counted as
    ``empty_lines`` on ``observation`` and dropped. Other columns are kept.
    Only the first word is extracted; lines are never split whole.
    """
    require_columns(lines, line, where="first_word_more")
    out = lines.withColumn("word", first_word(F.col(line)))
    if observation is not None:
        out = out.observe(observation,
                          F.count_if(F.col("word") == F.lit("")).alias("empty_lines"))
    return (out.where(F.col("word") != F.lit(""))
               .withColumn("more", is_single_word(F.col(line))))


def _json_fields(parsed: str, schema: T.StructType | str) -> list[Column]:
    """The declared fields of the first element of a parsed array; a value
    that cannot be of its field's type is NULL, like an absent one."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return [F.try_variant_get(parsed, f"$[0]['{f.name}']", f.dataType.simpleString())
            .alias(f.name) for f in schema.fields]


def parse_json_payload(df: DataFrame, schema: T.StructType | str, data: str = "data",
                       mode: str = "reject", out: str = "payload") -> DataFrame:
    """Decode the JSON in ``data`` (bytes or text) with a declared schema.

    ``mode="reject"`` keeps every row and adds ``out`` (NULL for malformed
    JSON) and ``json_error`` (true when malformed); ``mode="drop"`` keeps
    only decodable rows; ``mode="fail"`` stops the job on the first
    malformed row, like an uncaught ``json.loads`` error.
    """
    require_columns(df, data, where="parse_json_payload")
    # Parsed once: the text as the first of two elements of an array, the
    # second a hash of it. What follows a value, a second value, a bracket or
    # a loose spelling makes the array malformed or another one; the text is
    # well-formed when it is one object and the hash comes right after it.
    text = F.col(data).cast("string")
    mark = F.xxhash64(text)
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"),
                                       F.lit("]")))
    res = df.withColumn("_json", parsed)
    one = F.schema_of_variant(F.try_variant_get("_json", "$[0]", "variant")).startswith("OBJECT")
    then = F.try_variant_get("_json", "$[1]", "bigint") == mark
    valid = F.coalesce(one & then, F.lit(False))
    res = res.withColumn("json_error", ~valid).withColumn(
        out, F.when(valid, F.struct(*_json_fields("_json", schema)))).drop("_json")
    res = res.select(*[c for c in res.columns if c != "json_error"], "json_error")
    if mode == "reject":
        return res
    if mode == "drop":
        return res.where(~F.col("json_error")).drop("json_error")
    if mode == "fail":
        return (res.where(F.when(F.col("json_error"),
                                 F.raise_error(F.lit("malformed JSON payload")))
                           .otherwise(F.lit(True)))
                   .drop("json_error"))
    raise ValueError(f"unknown mode {mode!r}")
