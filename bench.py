"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each job is executed in full with the no-op sink (no driver collect), twice:
``queries`` has the first run (planning, code generation and worker start
included), ``second_run`` the one after it.  Prints one JSON line; ``value`` is
the sum of the first runs of the headline jobs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "v3_vector_topk", "g7_diverse_models", "v4_recommend", "b5_render_cards",
    "p11_route_messages", "p12_store_outcome", "j4_match_stores", "j7_history_reply", "j8_faq_section",
    "d1_split_sections", "w4_carry_query", "c2_keywords", "p3_detect_location",
    "g1_profile_columns", "g2_top_values", "g5_table_fingerprint", "g6_changed_rows", "b2_sanitize_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from quaymind.plans.registry import load_all
    from quaymind.session import get_session
    from quaymind.sources.fixtures import register

    spark = get_session(master=f"local[{cpus}]")
    reg = load_all()
    # JVM / Python-worker warm-up on the smallest scale (other data), not timed
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and warm != sf_dir:
        reg["g7_diverse_models"].run(spark, warm).write.format("noop").mode("overwrite").save()
    register(spark, sf_dir)
    names = [n for n in HEADLINE if n in reg]
    if len(sys.argv) > 1:
        names = [n for n in names if any(p in n for p in sys.argv[1:])]
    times, again = {}, {}
    for name in names:
        for into in (times, again):
            t0 = time.perf_counter()
            reg[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "second_run": again, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
