"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from synthtab.session import local_session  # noqa: E402

HEADLINE = [
    "gen_generic_ecommerce", "gen_names_emails", "generate_dataset_like_orders", "inject_mcar", "inject_mar",
    "inject_mnar", "inject_outliers", "inject_noise", "apply_profile", "iqr_outliers_injected",
    "skew_hints_lineitem", "null_pairs_masked", "missingness_masked", "fingerprint_lineitem",
    "fingerprint_events", "profile_columns_orders", "describe_customer", "ks_quality_orders",
    "spearman_lineitem", "quality_generated", "domain_schema_merge", "dataset_latest", "profile_merge",
    "resolve_descriptions", "schema_from_responses", "clean_documents",
]
GENERATED_ROWS = 10_000_000


def run_all(spark, folder: str) -> dict[str, float]:
    import synthtab as st
    from workloads.queries import QUERIES

    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    made = st.generate(spark, st.generic_schema("e-commerce"), GENERATED_ROWS, 1)
    made.write.format("noop").mode("overwrite").save()
    times["generate_10m_rows"] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "synthtab-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = run_all(spark, folder)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
