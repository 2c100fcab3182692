"""Filters, routes, guards, dead letters, projections, sources and sinks."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidepool.functions.parse import first_word_more, parse_json_payload, split_ws
from tidepool.functions.scalar import (as_float, as_int, decode_utf8, encode_bytes,
                                       end_of_time, format_pair, multiply, now_iso, path_join,
                                       split_tokens, timestamp_text, value_range)
from tidepool.operators.route import (dead_letter, dead_letter_expr, errors, fail_on_value,
                                      filter_by_attributes, retry_call, routes,
                                      row_budget_guard, split_threshold, tap)
from tidepool.sinks import with_attributes, write_lines, write_messages
from tidepool.sources.files import generate_sequence, inline_rows, read_lines, single_row
from tidepool.sources.messages import event_time_from_attribute, read_messages


def msgs(spark, rows):
    return spark.createDataFrame(
        [(json.dumps(d).encode(), a, None) for d, a in rows],
        "data binary, attributes map<string,string>, publish_time timestamp")


def test_filter_by_attributes_cases(spark):
    rows = [({"v": 1}, {"tags": "farm"}), ({"v": 2}, {"tags": "other"}),
            ({"v": 3}, {}), ({"v": 4}, {"tags": "farm", "x": "1"}), ({"v": 5}, {"tags": "mraf"})]
    m = msgs(spark, rows)
    keep = lambda f, **kw: sorted(r["payload"]["v"] for r in filter_by_attributes(
        m, f, schema="v INT", **kw).collect())
    assert keep({"tags": "farm"}) == [1, 4]                      # equal value; missing key drops
    assert keep({"tags": "farm", "x": "1"}) == [4]               # every filter must pass
    assert keep(None) == [1, 2, 3, 4, 5]                         # no filter decodes everything
    assert keep({"tags": ["farm"]}) == [1, 4]                    # a list is a subset test
    assert keep({"tags": "farm"}, match="chars") == [1, 4, 5]    # same letters, other order


def test_chars_mode_subset(spark):
    m = msgs(spark, [({"v": 1}, {"a": "xcbza"})])
    assert filter_by_attributes(m, {"a": "abc"}, match="chars").count() == 1
    assert filter_by_attributes(m, {"a": "abc"}).count() == 0


def test_parse_json_modes(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("not json",), ('{"k": 2}',)], "data string")
    r = parse_json_payload(df, "k INT").collect()
    assert [x["json_error"] for x in r] == [False, True, False]
    assert parse_json_payload(df, "k INT", mode="drop").count() == 2
    with pytest.raises(Exception):
        parse_json_payload(df, "k INT", mode="fail").collect()


def test_split_threshold_routes(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "x double")
    s = split_threshold(df, "x")
    r = routes(s)
    assert [x["x"] for x in r["lower"]().collect()] == [0.1]
    assert sorted(x["x"] for x in r["upper"]().collect()) == [0.5, 0.9]


def test_fail_on_value(spark):
    df = spark.range(10)
    assert fail_on_value(df, F.col("id") == 50).count() == 10
    with pytest.raises(Exception):
        fail_on_value(df, F.col("id") == 5, "five is not accepted").collect()


def test_row_budget_guard(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert row_budget_guard(df, 2, ["k"]).count() == 3
    with pytest.raises(Exception):
        row_budget_guard(df, 1, ["k"]).collect()


def test_dead_letter_keeps_item_in_main(spark):
    def _fail_on_five(x):  # defined here so it is shipped by value
        if x == 5:
            raise ValueError("five is not accepted")

    df = spark.range(10).withColumnRenamed("id", "item")
    d = dead_letter(df, _fail_on_five, ["item"], initial_delay=0.0)
    assert d.count() == 10
    e = errors(d).collect()
    assert [(r["item"], r["error"]["error_class"], r["error"]["message"]) for r in e] == [
        (5, "ValueError", "five is not accepted")]
    assert dead_letter(df, _fail_on_five, ["item"], initial_delay=0.0,
                       keep_failed=False).count() == 9
    x = dead_letter_expr(df, F.col("item") == 5, "ValueError", "five is not accepted")
    assert errors(x).count() == 1


def test_retry_call_retries_then_succeeds_or_raises():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("transient")
        return x * 2

    assert retry_call(flaky, retries=5, initial_delay=0.0)(4) == 8 and len(calls) == 3

    def always(x):
        raise ValueError("no")

    with pytest.raises(ValueError):
        retry_call(always, retries=2, initial_delay=0.0)(1)

    def other(x):
        calls.append("o")
        raise KeyError("not retried")

    n = len(calls)
    with pytest.raises(KeyError):
        retry_call(other, retries=5, initial_delay=0.0)(1)
    assert len(calls) == n + 1


def test_tap_counts_without_changing_rows(spark):
    obs = Observation("t")
    df = tap(spark.range(7), "seen", obs)
    assert df.count() == 7
    assert obs.get["seen_rows"] == 7


def test_first_word_more_and_empty_lines(spark):
    df = spark.createDataFrame([("  hello  ",), ("two words",), ("   ",), ("",)], "line string")
    obs = Observation("w")
    r = first_word_more(df, "line", obs).collect()
    assert [(x["word"], x["more"]) for x in r] == [("hello", True), ("two", False)]
    assert obs.get["empty_lines"] == 2


def test_split_tokens_unicode_whitespace(spark):
    df = spark.createDataFrame([("a  b\tc　　d ",)], "t string")
    assert [r["token"] for r in split_tokens(df, "t").collect()] == ["a", "b", "c", "d"]
    assert df.select(split_ws(F.col("t"))).first()[0] == "a  b\tc　　d ".split()


def test_scalars(spark):
    df = spark.createDataFrame([("3", " 7 ", "1.5", "1_0")], "a string, b string, c string, d string")
    r = df.select(as_int("a"), as_int("b"), as_int("c"), as_int("d"), as_float("c"),
                  multiply(encode_bytes(F.col("a")), 3)).first()
    assert tuple(r) == (3, 7, None, None, 1.5, 9)
    vr = spark.createDataFrame([(3,), (0,), (-2,)], "v int").select(value_range("v")).collect()
    assert [list(x[0]) for x in vr] == [[0, 1, 2], [], []]


@pytest.mark.parametrize("parts,expected", [
    (["a", "b", "c"], "a/b/c"), (["/beam", "graph-0", "x.ext"], "/beam/graph-0/x.ext"),
    (["a", "/b", "c"], "/b/c"), (["a/", "b"], "a/b"), (["a", ""], "a/"), (["", "b"], "b")])
def test_path_join_matches_os_path(spark, parts, expected):
    assert os.path.join(*parts) == expected
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(path_join("p")).first()[0] == expected


def test_utf8_roundtrip_and_strict(spark):
    df = spark.createDataFrame([(bytes("héllo", "utf-8"),), (b"\xff\xfe",)], "b binary")
    r = df.select(decode_utf8("b")).collect()
    assert r[0][0] == "héllo" and "�" in r[1][0]
    with pytest.raises(Exception):
        df.select(decode_utf8("b", strict=True)).collect()


def test_timestamps_text(spark):
    df = spark.sql("select timestamp'2015-11-16 13:11:03' a, timestamp'2015-11-16 13:11:03.5' b")
    r = df.select(timestamp_text(F.col("a")), timestamp_text(F.col("b")),
                  timestamp_text(end_of_time()), now_iso()).first()
    assert r[0] == "2015-11-16 13:11:03" and r[1] == "2015-11-16 13:11:03.500000"
    assert r[2] == "MAX" and r[3].endswith("Z") and "T" in r[3]


def test_format_pair(spark):
    df = spark.createDataFrame([("w", [True, False], ["a", "b"], True)],
                               "k string, v array<boolean>, s array<string>, b boolean")
    r = df.select(format_pair(F.col("k"), F.col("v"), "array<boolean>"),
                  format_pair(F.col("k"), F.col("s"), "array<string>"),
                  format_pair(F.col("k"), F.col("b"), "boolean")).first()
    assert tuple(r) == ("w: %s" % [True, False], "w: %s" % ["a", "b"], "w: True")


def test_sources(spark):
    assert [r["value"] for r in generate_sequence(spark, 1, 5).collect()] == [1, 2, 3, 4]
    assert single_row(spark).count() == 1
    assert inline_rows(spark, [(1,), (2,)], "x int").count() == 2


def test_lines_roundtrip(spark, tmp_dir):
    path = os.path.join(tmp_dir, "lines")
    df = spark.createDataFrame([("a",), ("b c",)], "value string")
    write_lines(df, path)
    assert sorted(r["value"] for r in read_lines(spark, path + "/*.txt").collect()) == ["a", "b c"]


def test_messages_roundtrip_and_event_time(spark, tmp_dir):
    path = os.path.join(tmp_dir, "msgs")
    src = spark.createDataFrame([("x", "1447679463000"), ("y", "2015-11-16T13:11:03.000Z")],
                                "d string, ts string")
    m = with_attributes(src, F.col("d"), timestamp=F.col("ts"), tags=F.lit("farm"))
    write_messages(m, path=path)
    back = read_messages(spark, path, streaming=False)
    et = event_time_from_attribute(back).select(
        F.unix_millis("event_time").alias("ms"), F.col("data").cast("string").alias("d")).collect()
    assert sorted((r["d"], r["ms"]) for r in et) == [("x", 1447679463000), ("y", 1447679463000)]


def test_whitespace_matches_python_split(spark):
    import random

    from tidepool.functions.parse import first_word, is_single_word, strip_ws
    pool = [chr(c) for c in range(0x3001)] + ["a", "b", "é", "語"] * 50
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    texts += ["\x1c a \x85", " x ", "\x0bword\x0b", "", "   "]
    ws = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts += ["".join(rnd.choice(ws + ["w"]) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", split_ws(F.col("t")).alias("s"), strip_ws(F.col("t")).alias("st"),
                    first_word(F.col("t")).alias("f"), is_single_word(F.col("t")).alias("one"))
    for r in got.collect():
        t = r["t"]
        assert list(r["s"]) == t.split(), repr(t)
        assert r["st"] == t.strip(), repr(t)
        assert r["f"] == (t.split()[0] if t.split() else ""), repr(t)
        assert r["one"] == (len(t.split()) == 1), repr(t)


def test_path_join_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    part = st.text(alphabet="ab/.", max_size=4)
    cases = []

    @settings(max_examples=300, database=None)
    @given(st.lists(part, min_size=1, max_size=5))
    def collect(parts):
        cases.append(parts)

    collect()
    df = spark.createDataFrame([(p,) for p in cases], "p array<string>")
    got = [r[0] for r in df.select(path_join("p")).collect()]
    assert got == [os.path.join(*p) for p in cases]


def test_as_int_property(spark):
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st

    texts = []

    @settings(max_examples=400, database=None)
    @given(st.text(alphabet=" +-0123456789._\t", max_size=8))
    def collect(t):
        texts.append(t)

    collect()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(as_int("t")).collect()]

    def py_int(t):  # int() of a byte string without digit separators (no '_')
        if "_" in t or not re.fullmatch(r"\s*[+-]?[0-9]+\s*", t):
            return None
        v = int(t)
        return v if -2**63 <= v < 2**63 else None

    assert got == [py_int(t) for t in texts]


def test_key_by(spark):
    from tidepool.functions.scalar import key_by
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    got = key_by(df, F.col("x") * 10).collect()
    assert [tuple(r) for r in got] == [(10, 1, "a"), (20, 2, "b")]
    assert key_by(df, "y", keep=False).columns == ["key"]


def test_paced_sequence_stream(spark, tmp_dir):
    import time
    s = generate_sequence(spark, start=5, stop=8, streaming=True, rows_per_second=50)
    q = (s.writeStream.format("parquet").option("path", tmp_dir + "/out")
          .option("checkpointLocation", tmp_dir + "/ck").trigger(processingTime="1 second")
          .start())
    deadline = time.time() + 60
    try:
        while time.time() < deadline:
            time.sleep(1)
            try:
                got = sorted({r["value"] for r in spark.read.parquet(tmp_dir + "/out").collect()})
            except Exception:  # no file written yet
                got = []
            if got == [5, 6, 7]:
                break
    finally:
        q.stop()
    assert got == [5, 6, 7]


def test_kafka_without_connector_says_so(spark):
    from tidepool.sources.messages import kafka_to_messages, read_kafka
    try:
        df = read_kafka(spark, "localhost:9", "t")
    except RuntimeError as e:
        assert "Kafka connector" in str(e)
    else:  # a connector is installed: the mapping to messages still applies
        assert kafka_to_messages(df).columns == ["data", "attributes", "publish_time"]


def test_fan_out_materialized(spark):
    from tidepool.operators.route import fan_out
    df = spark.range(10)
    a, b = fan_out(df, lambda d: d.where("id < 3"), lambda d: d.where("id >= 7"),
                   materialize=True)
    assert a.count() == 3 and b.count() == 3


def test_count_where_counters(spark):
    from tidepool.operators.route import count_where
    obs = Observation("c")
    df = count_where(spark.range(10), obs, evens=F.col("id") % 2 == 0, big=F.col("id") > 7)
    assert df.count() == 10
    assert obs.get == {"evens": 5, "big": 2}


def test_message_strings_and_event_time_columns(spark, tmp_dir):
    from tidepool.functions.scalar import assign_event_time, with_event_time
    from tidepool.sources.messages import read_message_strings
    path = os.path.join(tmp_dir, "m")
    src = spark.createDataFrame([("héllo",)], "d string")
    write_messages(with_attributes(src, F.col("d")), path=path)
    assert [r["value"] for r in read_message_strings(spark, path, streaming=False).collect()] \
        == ["héllo"]
    df = spark.createDataFrame([(1447679463000, 1447679463.5)], "ms long, s double")
    r = (assign_event_time(df, millis="ms").transform(lambda d: with_event_time(d, "event_time"))
         .select(F.unix_millis("event_time"), "is_end").first())
    assert tuple(r) == (1447679463000, False)
    r2 = assign_event_time(df, seconds="s").select(F.unix_millis("event_time")).first()[0]
    assert r2 == 1447679463500
    with pytest.raises(ValueError):
        assign_event_time(df)


def test_tap_sample_batch_and_stream(spark, tmp_dir):
    from tidepool.operators.route import tap_sample
    from tidepool.streaming.replay import replay_stream, write_replay_files
    seen = []
    tap_sample(spark.range(100), "ids", n=3, log=seen.append)
    assert len(seen) == 3 and seen[0].startswith("ids: Row(")
    df = spark.range(10).withColumnRenamed("id", "i")
    path, n = write_replay_files(df, "i", 2)
    st = replay_stream(spark, path, df.schema, n)
    w = tap_sample(st, "stream", n=2, log=seen.append)
    q = w.option("checkpointLocation", tmp_dir + "/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(1 for x in seen if x.startswith("stream[")) == 4  # 2 batches x 2 rows
