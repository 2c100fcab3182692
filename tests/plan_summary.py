"""Summarize the physical plan of every batch query: shuffles, broadcasts,
Python stages, pushed filters and the columns read. Writes PLANS.md.

Usage: ``python tests/plan_summary.py [sf_dir]`` (default sf0.01). Plans are
taken before AQE re-planning (``isFinalPlan=false``); AQE may still turn a
shuffle join into a broadcast join once it has measured a side.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(plan: str) -> dict:
    nodes = re.findall(r"^\(\d+\) ([A-Za-z]+)", plan, flags=re.M)
    count = lambda n: sum(1 for x in nodes if x == n)
    scans = re.findall(r"ReadSchema: (struct<.*?>)\s*$", plan, flags=re.M)
    pushed = [p for p in re.findall(r"PushedFilters: \[(.*?)\]\s*$", plan, flags=re.M) if p]
    kinds = ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython",
             "FlatMapGroupsInPandas")
    python = [f"{count(k)} {k}" for k in kinds if count(k)]
    return {"exchanges": count("Exchange"), "broadcasts": count("BroadcastExchange"),
            "windows": count("Window"), "python": python, "scans": scans, "pushed": pushed}


def main() -> None:
    from tidepool.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8,
                          extra={"spark.ui.showConsoleProgress": "false"})
    import __spark_entry__ as E
    lines = ["# Physical plans of the batch queries", "",
             f"Generated by `tests/plan_summary.py` on `{sf}`: shuffles (`Exchange`), "
             "broadcasts, windows, Python stages, filters pushed into the Parquet scan and "
             "the columns each scan reads. Streaming twins run through Structured Streaming "
             "and are not listed; the llm queries run several jobs each.", "",
             "| query | shuffles | broadcasts | windows | python | pushed filters | columns read |",
             "|---|---|---|---|---|---|---|"]
    for name in sorted(E.QUERIES):
        if name.startswith("stream_"):
            continue
        df = E.QUERIES[name](spark, sf)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarize(plan)
        cols = "; ".join(sorted({re.sub(r":[a-z_]+(<[^>]*>)?", "", x)[7:-1] for x in s["scans"]}))
        lines.append(f"| {name} | {s['exchanges']} | {s['broadcasts']} | {s['windows']} | "
                     f"{', '.join(s['python']) or '-'} | {'; '.join(s['pushed']) or '-'} | "
                     f"{cols} |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
