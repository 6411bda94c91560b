"""Write docs/PLANS.md: the physical plan tree of each headline job with
its shuffle / broadcast / top-k-limit counts and the Parquet scan pushdown.

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from quaymind.plans.registry import load_all  # noqa: E402
from quaymind.session import get_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    reg = load_all()
    out = ["# Physical plans of the headline jobs", "",
           f"Generated by `tools/dump_plans.py` at `{os.path.basename(sf)}` (initial AQE plans, before runtime re-planning).",
           "Counts: `Exchange` = shuffles, `BroadcastExchange` = broadcasts, `WindowGroupLimit` = partial/final top-k limits.", ""]
    for name in HEADLINE:
        df = reg[name].run(spark, sf)
        from quaymind.functions.text import PY_WS_CHARS
        plan = df._jdf.queryExecution().executedPlan().toString().replace(PY_WS_CHARS, "<py-whitespace>")
        tree = [ln for ln in plan.splitlines() if ln.strip()]
        shuffles = len(re.findall(r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bcast = plan.count("BroadcastExchange")
        wgl = plan.count("WindowGroupLimit")
        scans = re.findall(r"FileScan parquet [^\n]*", plan)
        out += [f"## {name}", "", f"{reg[name].doc}", "",
                f"- shuffles: {shuffles}, broadcasts: {bcast}, WindowGroupLimit nodes: {wgl}", ""]
        for s in scans:
            tbl = re.search(r"Location: InMemoryFileIndex[^\[]*\[[^\]]*/([a-z_]+)\.parquet", s)
            rs = re.search(r"ReadSchema: (\S+)", s)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", s)
            out.append(f"- scan `{tbl.group(1) if tbl else '?'}` read {rs.group(1) if rs else '?'}"
                       f"{' pushed ' + pf.group(1) if pf and pf.group(1) != '[]' else ''}")
        out += ["", "```"] + [re.sub(r"#\d+L?", "", ln)[:160] for ln in tree if not ln.lstrip().startswith("+- FileScan")
                               and "FileScan" not in ln] + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    print("wrote docs/PLANS.md")


if __name__ == "__main__":
    main()
