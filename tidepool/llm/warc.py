"""Not-modified revisit records resolved to the response they revisit.

A revisit record (a server answered 304) stands for the body of an earlier
capture of the same page. Every revisit is joined, as of its time, to the
latest earlier full response of the same canonical URL; validators are
checked and the headers that a 304 may update are merged into the stored
ones. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import small, written

# What the operator reads; other columns are ignored.
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),     # response or revisit
    T.StructField("url", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.StringType()),
])
# The fields a 304 response updates (lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified",
             "vary")
# Query parameters that do not name another page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"
# Bytes of a row in the table of URLs with very many records, at most about.
URL_BYTES = 512


def canonical_url(url: Column) -> Column:
    """The key of a page: host in lower case without user, ``www.`` and
    default port, path without a last ``index.html`` and slashes at its end,
    parameters without tracking ones, sorted; no scheme, no fragment. Null
    for null and for text without a host."""
    parts = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?"
    host = F.lower(F.regexp_extract(url, parts, 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"(/index\.html?)?/*$", "")
    query = F.filter(F.split(F.regexp_extract(url, parts, 3), "&"),
                     lambda p: (p != "") & ~p.rlike(TRACKING))
    joined = F.array_join(F.array_sort(query), "&")
    return F.when(host != "", F.concat(host, path, F.when(joined != "", F.concat(
        F.lit("?"), joined)).otherwise(F.lit(""))))


def header_list(headers: Column) -> Column:
    """A header map as ``array<struct<name, value>>``: names in lower case,
    sorted, the greatest value of names that differ by case only."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(F.trim(e["key"])).alias("name"), F.trim(e["value"]).alias("value"))))
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    last = F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: e["name"] == n), -1))
    return F.coalesce(last, F.array().cast("array<struct<name:string,value:string>>"))


def _value(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda e: e["name"] == name), F.lit(0))["value"]


def merged_headers(stored: Column, update: Column, permitted: tuple = PERMITTED) -> Column:
    """``stored`` with the permitted fields of ``update`` in place of its own."""
    new = F.filter(update, lambda e: e["name"].isin(*permitted))
    names = F.transform(new, lambda e: e["name"])
    return F.array_sort(F.concat(
        F.filter(stored, lambda e: ~F.array_contains(names, e["name"])), new))


def _validated(stored: Column, update: Column) -> Column:
    """True, false, or null if the two share no validator: entity tags
    compared weakly, else modification dates compared as text."""
    tag = lambda h: F.regexp_replace(_value(h, "etag"), r"^[Ww]/", "")
    return F.coalesce(tag(stored) == tag(update),
                      _value(stored, "last-modified") == _value(update, "last-modified"))


def _busy_urls(known: DataFrame) -> tuple[DataFrame, int, int]:
    """URLs with more records than the square root of all records, hence
    fewer URLs than that: their table, its rows, and their records."""
    counts = written(known.groupBy("url_key").agg(F.count("*").alias("rows")), "urls")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
    busy = counts.where(F.col("rows") > math.isqrt(total))
    n, rows = busy.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).head()
    return busy.select("url_key"), n, rows


def _time_splits(busy: DataFrame, slices: int) -> tuple[list[float], list[float]]:
    """Bounds of ``slices`` time slices with about as many records each, and
    the starts of slices of one time only. A time that fills a slice and more
    is a slice of its own (doubles tell whole microseconds apart up to 2^53)."""
    shares = [i / slices for i in range(1, slices)]
    bounds = busy.approxQuantile("at", shares, 0.1 / slices) if shares else []
    full = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b and abs(a) < 2 ** 53})
    splits = sorted({*bounds, *full, *(t + 1 for t in full)})
    return [float("-inf"), *(splits or [0.0]), float("inf")], full


def resolve_revisits(records: DataFrame, permitted: tuple = PERMITTED,
                     slices: int | None = None) -> DataFrame:
    """One row per revisit record: ``record_id, url_key, captured_at,
    resolution, resolved_id, status, headers, payload_sha256, payload_bytes``.

    ``resolution`` is ``resolved``, ``validator_mismatch``, ``no_validator``
    (the latest earlier response shares no validator with the revisit),
    ``no_response`` (none is earlier) or ``unusable`` (no URL key or time);
    what follows it is null unless resolved. Full responses have type
    ``response`` and status 200; earlier means a smaller time; of responses
    at one time the greatest record id counts. Null headers are empty, a null
    payload is empty. Repeated rows are resolved alike and all stay.

    Payloads are digested before anything is shuffled. So that one URL with
    very many records is not one task, the records of such URLs are dealt by
    URL and time slice (quantiles of their times; ``slices`` of them, by
    default the square root of their number, so that slices and the records
    of one grow alike); the last response of the slices before is carried in
    from a table with one row per URL and slice. A time with more records than
    a slice is a slice by itself: nothing in it is earlier, so its revisits
    take what is carried in and are never gathered."""
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    revisit = F.col("record_type") == "revisit"
    read = records.where(full | revisit).select(
        "record_id", revisit.alias("is_revisit"), canonical_url(F.col("url")).alias("url_key"),
        "captured_at", "status", header_list(F.col("headers")).alias("headers"),
        F.when(full, F.sha2(F.coalesce(F.col("payload"), F.lit("")).cast("binary"), 256))
        .alias("sha256"),
        F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("bytes"))
    us = F.unix_micros("captured_at")
    narrow = written(read.select(
        "record_id", "is_revisit", "url_key", "captured_at", us.alias("us"),
        us.cast("double").alias("at"), "headers",
        F.when(~F.col("is_revisit"), F.struct(us.alias("us"), "record_id", "status", "headers",
                                              "sha256", "bytes")).alias("response")), "captures")
    usable = F.col("url_key").isNotNull() & F.col("us").isNotNull()
    known = narrow.where(usable)
    urls, n_urls, rows = _busy_urls(known)
    marked = known.join(small(urls.withColumn("busy", F.lit(True)), URL_BYTES, n_urls),
                        "url_key", "left")
    splits, full = _time_splits(marked.where("busy"), slices or math.isqrt(rows) or 1)
    by_time = Bucketizer(splits=splits, inputCol="at", outputCol="time_slice")
    dealt = by_time.transform(marked).withColumn(
        "slice", F.when(F.col("busy"), F.col("time_slice")).otherwise(-1.0))
    one_time = F.col("slice").isin([float(splits.index(t)) for t in full])

    last = dealt.where("NOT is_revisit").groupBy("url_key", "slice").agg(
        F.max("response").alias("response"))
    slices_with_rows = dealt.where("is_revisit").groupBy("url_key", "slice").agg(
        F.lit(None).cast(last.schema["response"].dataType).alias("response"))
    per_slice = last.unionByName(slices_with_rows).groupBy("url_key", "slice").agg(
        F.max("response").alias("response"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = per_slice.select("url_key", "slice", F.max("response").over(earlier).alias("carried"))

    within = Window.partitionBy("url_key", "slice").orderBy("us").rangeBetween(
        Window.unboundedPreceding, -1)
    found = dealt.where(~one_time).withColumn("own", F.max("response").over(within)) \
        .where("is_revisit")
    stored = F.coalesce("own", "carried")
    joined = found.join(carried, ["url_key", "slice"], "left").select(
        "record_id", "url_key", "captured_at", "headers", stored.alias("stored"))
    if full:
        joined = joined.unionByName(dealt.where(one_time & F.col("is_revisit")).join(
            carried, ["url_key", "slice"], "left").select(
            "record_id", "url_key", "captured_at", "headers", F.col("carried").alias("stored")))
    lost = narrow.where(F.col("is_revisit") & ~usable).select(
        "record_id", "url_key", "captured_at", "headers",
        F.lit(None).cast(joined.schema["stored"].dataType).alias("stored"))
    ok = _validated(F.col("stored.headers"), F.col("headers"))
    judged = joined.unionByName(lost).withColumn(
        "resolution", F.when(F.col("url_key").isNull() | F.col("captured_at").isNull(), "unusable")
        .when(F.col("stored").isNull(), "no_response").when(ok.isNull(), "no_validator")
        .when(ok, "resolved").otherwise("validator_mismatch"))
    good = F.col("resolution") == "resolved"
    return judged.select(
        "record_id", "url_key", "captured_at", "resolution",
        F.when(good, F.col("stored.record_id")).alias("resolved_id"),
        F.when(good, F.col("stored.status")).alias("status"),
        F.when(good, merged_headers(F.col("stored.headers"), F.col("headers"), permitted))
        .alias("headers"),
        F.when(good, F.col("stored.sha256")).alias("payload_sha256"),
        F.when(good, F.col("stored.bytes")).alias("payload_bytes"))


def attach_payloads(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved rows with the ``payload`` of the response they stand for
    (null where unresolved): one join on the record id and the digest, since
    several responses may have one record id. Equal bodies of one id are one."""
    body = F.sha2(F.coalesce(F.col("payload"), F.lit("")).cast("binary"), 256)
    bodies = records.where("record_type = 'response' AND record_id IS NOT NULL").groupBy(
        F.col("record_id").alias("resolved_id"), body.alias("payload_sha256")).agg(
        F.max("payload").alias("payload"))
    return resolved.drop("payload").join(bodies, ["resolved_id", "payload_sha256"], "left") \
        .select(*[c for c in resolved.columns if c != "payload"], "payload")
