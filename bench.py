"""Time the main queries; prints one line of JSON.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed
runs after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from tableprep.session import build_session  # noqa: E402

HEADLINE = """
    search_any rule_set sort_page lookup_nation lookup_many update_by_key value_map formula conditional split_fixed
    regex_extract_text date_standardize name_split email_check currency_comma unit_mass phone_fr text_repair
    zone_normalize column_stats top_values duplicate_summary dedup_first dedup_smart merge_duplicates_text pivot_sum
    grouped_avg unpivot_numbers calendar row_diff row_diff_bag row_diff_key health_columns mainframe_report histogram zscore_top
    dual_measure daily_counts near_pairs near_clusters near_clusters_dense fingerprint_clusters roundtrip_semicolon jagged_rows
    fixed_width_roundtrip enrich_merge recipe_replay
""".split()


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))


if __name__ == "__main__":
    main()
