"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from session import make_session  # noqa: E402

from jobweave import catalog  # noqa: E402

HEADLINE = [
    "d0_silver_table",               # builds and writes the silver table, then reads it
    "c1_remove_html_tags", "c6_remove_duplicates", "b3_posting_source_b", "b34_ingest_funnel",
    "e8_apply_filters", "g1_overview_kpis", "g3_value_counts_company_name", "g7_median_salary_by_role",
    "g10_high_paying_skills", "g10_median_price_by_brand", "g13_skill_by_role", "g18_city_profile",
    "g26_validate_dataset", "h2_cumulative_share", "m1_correlation_matrix", "n3_month_by_role",
    "o2_box_stats", "p16_skill_cooccurrence_matrix", "p19_trending_skills",
    "k2_extract_skills", "k5_corpus_keywords", "k10_skill_pairs", "l2_sections", "l8_match_scores",
    "l13_top_postings", "s2_live_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = make_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
