"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from acopio.plans import load_queries
from acopio.plans.registry import QUERIES
from acopio.session import build_session

HEADLINE = [
    "fact_students", "fact_admin", "fact_staff", "outer_merge_nullsafe", "dim_institution", "dim_text",
    "match_key", "normalize_text", "nullify_tokens", "base_clean", "normalize_sex", "trim_footer",
    "detect_header_row", "year_scan", "match_columns", "variant_report", "value_counts", "top_n_per_group",
    "surrogate_keys_ranged", "fk_semi", "fk_text_lookup", "upsert_by_year", "describe_features", "standardize",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    load_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
