"""Run registered queries with Spark and their oracles with DuckDB, compare.

Comparison as the driver describes it: columns sorted by name, column
types, row count, and the multiset of rows. Usage: ``python tests/oracle_compare.py [sf_dir]
[name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return round(v, 6)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, bool):
        return bool(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records")]
    return cols, sorted(rows, key=repr)


# DuckDB result types as Spark names them (for the schema part of the check)
_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string",
                  "BOOLEAN": "boolean", "DOUBLE": "double"}


def _type_mismatches(spark_df, rel) -> list[str]:
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    out = []
    for f in spark_df.schema.fields:
        d = duck.get(f.name, "MISSING")
        if _DUCK_TO_SPARK.get(d, d) != f.dataType.simpleString():
            out.append(f"{f.name}: {f.dataType.simpleString()} vs {d}")
    return out


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            got = sdf.toPandas()
        except Exception as e:  # report and continue
            results[name] = f"spark error: {str(e).splitlines()[0][:300]}"
            if verbose:
                print(f"{name:32s} SPARK ERROR {results[name]}")
            continue
        ts = time.time() - t0
        if name not in sql:
            results[name] = f"rows-only ({len(got)} rows)"
            if verbose:
                print(f"{name:32s} rows-only {len(got)} rows  {ts:.1f}s")
            continue
        try:
            rel = con.sql(sql[name])
            types_bad = _type_mismatches(sdf, rel)
            exp = rel.df()
        except Exception as e:
            results[name] = f"oracle error: {str(e).splitlines()[0][:300]}"
            if verbose:
                print(f"{name:32s} ORACLE ERROR {results[name]}")
            continue
        gc, gr = _rows(got)
        ec, er = _rows(exp)
        ok = gc == ec and gr == er and not types_bad
        msg = "ok" if ok else "MISMATCH"
        if types_bad:
            msg += f" types {types_bad}"
        if not ok:
            if gc != ec:
                msg += f" cols {gc} vs {ec}"
            else:
                msg += f" rows {len(gr)} vs {len(er)}"
                sg, se = set(gr), set(er)
                msg += f" e.g. spark-only {list(sg - se)[:2]} oracle-only {list(se - sg)[:2]}"
        results[name] = msg
        if verbose:
            print(f"{name:32s} {msg[:400]}  ({len(gr)} rows, {ts:.1f}s)")
    return results


if __name__ == "__main__":
    from tidepool.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    extra = {"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    if os.environ.get("HOT_KEY_ROWS"):  # e.g. 0 forces the range-partitioned scan
        extra["tidepool.hotKeyRows"] = os.environ["HOT_KEY_ROWS"]
    if os.environ.get("PLAIN_SESSION"):  # a session without the library's defaults
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    else:
        spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if not (v == "ok" or v.startswith("rows-only"))]
    print(f"{len(res) - len(bad)}/{len(res)} passed; failing: {bad}")
