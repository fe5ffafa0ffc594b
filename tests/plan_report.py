"""Physical-plan summary per registered query (markdown table on stdout).

    python -m tests.plan_report [sf_dir] > PLANS.md

Counts shuffles (hash / range / single-partition exchanges), broadcasts, window
operators and Python stages in the executed plan (before adaptive re-planning),
and lists the columns each Parquet scan reads.
"""

from __future__ import annotations

import re
import sys

SKIP = {"elo_relaxed", "elo_blocked", "gbt_fit_score", "score_matchups", "odds_stream",
        "odds_stream_closing", "odds_stream_candles", "odds_stream_close_emit", "land_game_log"}


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = []
    for line in plan.splitlines():
        if "FileScan" in line:
            m = re.search(r"ReadSchema: struct<([^>]*)>", line)
            t = re.search(r"/([a-z_]+)\.parquet", line)
            cols = [c.split(":")[0] for c in m.group(1).split(",")] if m else []
            scans.append(f"{t.group(1) if t else '?'}({','.join(cols)})")
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)),
        "broadcast": plan.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow(GroupLimit)? ", plan)),
        "python": len(re.findall(r"FlatMapGroupsInPandas|FlatMapCoGroupsInPandas|ArrowEvalPython|MapInPandas", plan)),
        "scans": "; ".join(sorted(set(scans))),
    }


def main() -> None:
    sys.path.insert(0, ".")
    from scoreline.session import get_spark
    import __spark_entry__ as ent

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    print("| key | exchanges | broadcasts | windows | python | scans (columns read) |")
    print("|---|---|---|---|---|---|")
    for k, fn in ent.queries().items():
        if k in SKIP:
            continue
        s = summarize(fn(spark, sf))
        print(f"| {k} | {s['exchanges']} | {s['broadcast']} | {s['windows']} | {s['python']} | {s['scans']} |")


if __name__ == "__main__":
    main()
