"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds per query (warm, best of two)."""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

HEADLINE = (
    "scan_filter_project join_inner join_left join_correlated_count agg_group_having agg_distinct agg_lower_median set_intersect top3_per_group latest_per_key "
    "scalar_string scalar_date weighted_quantiles scd2_windows fact_as_of rank_velocity interval_union_coverage upsert terms_document_frequency copies_pairs "
    "growth_test trend_score gtin_checksum economics_unit url_canonical page_lines stream_tumbling"
).split()


def main() -> None:
    from tidemark import plans, session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = session.build(f"local[{cpus}]", "bench", **{"spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": shared, "spark__driver__memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder}))


if __name__ == "__main__":
    main()
