"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabletypes import catalog  # noqa: E402
from tabletypes.plans.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_label_report",
    "c1_to_cells",
    "a1_numeric_profile",
    "a4_char_features",
    "a5_text_stats",
    "w2_inverse_transform",
    "f2_storage_type",
    "l1_lf_value_overlap",
    "l2_lf_value_pattern",
    "l4_numeric_emd",
    "j5_overlap_join_candidates",
    "v1_majority_vote",
    "m5_ranking_measures",
    "j8_header_header",
    "a10_entity_term_freq",
    "r2_bm25_search",
    "r6_rank_rows",
    "e4_linking_examples",
    "d2_entity_examples",
    "d4_negative_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, memory="16g")
    catalog.QUERIES["c1_to_cells"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
