"""Revisit records: URL keys, as-of choice, validators, merged headers."""

import datetime as dt

from pyspark.sql import functions as F

from tidepool.llm.warc import (RECORD, _busy_urls, _time_splits, attach_payloads, canonical_url,
                                resolve_revisits)

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def response(rid, url, minutes, headers=None, payload="body", status=200):
    return (rid, "response", url, None if minutes is None else at(minutes), status, headers,
            payload)


def revisit(rid, url, minutes, headers=None):
    return (rid, "revisit", url, None if minutes is None else at(minutes), 304, headers, None)


def resolved(spark, rows, **kw):
    out = resolve_revisits(spark.createDataFrame(rows, RECORD), **kw)
    return {r.record_id: r for r in out.collect()}


def test_url_keys(spark):
    urls = {"http://www.A.com:80/x/index.html": "a.com/x", "https://a.com/x/?utm_source=q#top": "a.com/x",
            "//user:p@a.com/x?b=2&a=1&ref=z": "a.com/x?a=1&b=2", "HTTPS://A.com": "a.com",
            "a.com/x": None, "": None, None: None, "http:///x": None, "http://a.com/X": "a.com/X",
            "https://a.com:8080/": "a.com:8080", "http://a.com/?referrer=1": "a.com?referrer=1"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: r.k for r in df.select("u", canonical_url(F.col("u")).alias("k")).collect()}
    assert got == urls


TAG = {"ETag": '"1"', "Content-Type": "text/html", "Date": "d0"}


def test_latest_earlier_response_counts(spark):
    rows = [response("r1", "http://a.com/", 0, TAG, "one"),
            response("r2", "https://www.a.com", 10, {"etag": 'W/"2"'}, "two"),
            response("r3", "http://a.com/", 30, TAG, "late"),
            response("r0", "http://a.com/", 15, {"etag": '"2"'}, "no", status=500),
            revisit("v1", "http://a.com/#x", 20, {"ETAG": '"2"'}),
            revisit("v2", "http://a.com/", 5, {"etag": 'W/"1"'}),
            revisit("v3", "http://a.com/", 20, {"etag": '"1"'}),
            revisit("v4", "http://a.com/", 0, {"etag": '"1"'}),
            revisit("v5", "http://b.com/", 20, {"etag": '"1"'})]
    for slices in (1, 2, 50):
        got = resolved(spark, rows, slices=slices)
        assert {k: (r.resolution, r.resolved_id) for k, r in got.items()} == {
            "v1": ("resolved", "r2"), "v2": ("resolved", "r1"),
            "v3": ("validator_mismatch", None), "v4": ("no_response", None),
            "v5": ("no_response", None)}
    assert got["v1"].payload_bytes == 3 and got["v3"].payload_bytes is None


def test_headers_merge_only_what_is_permitted(spark):
    rows = [response("r", "http://a.com/", 0, {**TAG, "X-Own": "1", "Content-Length": "4"}),
            revisit("v", "http://a.com/", 1, {"etag": '"1"', "date": "d1", "Content-Length": "0",
                                              "Cache-Control": "no-store", "x-own": "2",
                                              "content-type": "x"})]
    got = {h.name: h.value for h in resolved(spark, rows)["v"].headers}
    assert got == {"etag": '"1"', "date": "d1", "content-length": "4", "x-own": "1",
                   "content-type": "text/html", "cache-control": "no-store"}


def test_validators(spark):
    rows = [response("r1", "http://a.com/", 0, {"last-modified": "m"}),
            response("r2", "http://b.com/", 0, None),
            revisit("v1", "http://a.com/", 1, {"Last-Modified": "m"}),
            revisit("v2", "http://a.com/", 1, {"Last-Modified": "n"}),
            revisit("v3", "http://a.com/", 1, {"etag": '"1"'}),
            revisit("v4", "http://b.com/", 1, None),
            revisit("v5", "http://a.com/", 1, {"etag": '"1"', "last-modified": "m"})]
    assert {k: r.resolution for k, r in resolved(spark, rows).items()} == {
        "v1": "resolved", "v2": "validator_mismatch", "v3": "no_validator",
        "v4": "no_validator", "v5": "resolved"}


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [response("r1", "http://a.com/", 0, TAG, "x"), response("r2", "http://a.com/", 0, TAG, None),
            response("r2", "http://a.com/", 0, TAG, None), response(None, "http://a.com/", None, TAG),
            revisit("v1", "http://a.com/", 1, TAG), revisit("v1", "http://a.com/", 1, TAG),
            revisit("v2", None, 1, TAG), revisit("v3", "http://a.com/", None, TAG),
            (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD).withColumns(
        {"us": F.lit("x"), "response": F.lit(1), "slice": F.lit(2), "carried": F.lit(3)})
    out = [(r.record_id, r.resolution, r.resolved_id, r.payload_bytes)
           for r in resolve_revisits(df).collect()]
    assert sorted(out, key=str) == sorted([
        ("v1", "resolved", "r2", 0), ("v1", "resolved", "r2", 0), ("v2", "unusable", None, None),
        ("v3", "unusable", None, None)], key=str)
    assert resolved(spark, []) == {}
    assert resolved(spark, [revisit("v", "http://a.com/", 1, TAG)])["v"].resolution == "no_response"


def test_one_url_with_most_rows(spark):
    rows = [response(f"r{i:04d}", "http://hot.com/", 2 * i, {"etag": f'"{i}"'}, "p" * i)
            for i in range(200)]
    rows += [revisit(f"v{i}", "http://hot.com/", 2 * i + 1, {"etag": f'"{i}"'}) for i in range(200)]
    got = resolved(spark, rows, slices=16)
    assert all(got[f"v{i}"].resolved_id == f"r{i:04d}" and got[f"v{i}"].payload_bytes == i
               for i in range(200))


def test_one_url_with_most_rows_at_one_time(spark):
    rows = [response(f"r{i:04d}", "http://hot.com/", 7, TAG, "p" * i) for i in range(200)]
    rows += [revisit(f"v{i}", "http://hot.com/", 7, TAG) for i in range(200)]
    rows += [response("r", "http://hot.com/", 6, TAG, "first"), revisit("u", "http://hot.com/", 6, TAG),
             revisit("w", "http://hot.com/", 8, TAG)]
    rows += [response(f"s{i}", f"http://{i}.com/", 7, TAG) for i in range(30)]
    rows += [revisit(f"t{i}", f"http://{i}.com/", 7 + i % 2, TAG) for i in range(30)]
    for slices in (None, 1, 2, 9):
        got = resolved(spark, rows, slices=slices)
        assert {got[f"v{i}"].resolved_id for i in range(200)} == {"r"}
        assert got["u"].resolution == "no_response" and got["w"].resolved_id == "r0199"
        assert all(got[f"t{i}"].resolved_id == (f"s{i}" if i % 2 else None) for i in range(30))


def test_slices_follow_the_busy_urls(spark):
    rows = [(f"{i % 50}.com" if i % 3 else "hot.com", float(i // 2)) for i in range(3_000)]
    known = spark.createDataFrame(rows, "url_key string, at double")
    urls, n, total = _busy_urls(known)
    assert [r.url_key for r in urls.collect()] == ["hot.com"] and (n, total) == (1, 1_000)
    splits, full = _time_splits(known.where("url_key = 'hot.com'"), 31)
    times = [t for u, t in rows if u == "hot.com"]
    held = [sum(a <= t < b for t in times) for a, b in zip(splits, splits[1:])]
    assert not full and sum(held) == 1_000 and max(held) <= 2 * 1_000 / 31
    splits, full = _time_splits(known.withColumn("at", F.least("at", F.lit(9.0))), 31)
    assert full == [9.0] and splits[splits.index(9.0) + 1] == 10.0


def test_payloads_can_be_attached(spark):
    rows = [response("r", "http://a.com/", 0, TAG, "body"), revisit("v", "http://a.com/", 1, TAG),
            revisit("w", "http://b.com/", 1, TAG)]
    df = spark.createDataFrame(rows, RECORD)
    got = {r.record_id: r.payload for r in attach_payloads(resolve_revisits(df), df).collect()}
    assert got == {"v": "body", "w": None}


def test_payloads_of_responses_of_one_id(spark):
    rows = [response("r", "http://a.com/", 0, TAG, "zzz"), response("r", "http://b.com/", 0, TAG, "aaa"),
            revisit("v", "http://a.com/", 1, TAG), revisit("w", "http://b.com/", 1, TAG)]
    df = spark.createDataFrame(rows, RECORD)
    got = {r.record_id: r.payload for r in attach_payloads(resolve_revisits(df), df).collect()}
    assert got == {"v": "zzz", "w": "aaa"}
