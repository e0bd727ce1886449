"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import warnings
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loomstat.plans.catalog import QUERIES  # noqa: E402
from loomstat.session import local_session  # noqa: E402

HEADLINE = [
    "describe", "null_counts", "constant_columns", "histogram", "kde", "boxplot", "rolling_mean", "rolling_mean_by_series",
    "corr_matrix", "fold_gram", "hash_split", "exact_split", "prepare_table", "ols_simple", "ols_summary", "metrics",
    "durbin_watson", "breusch_pagan", "residual_trend", "qq_points", "stepwise_path", "forward_cv_select", "ridge_cv",
    "lasso_cv", "elasticnet_cv", "ridge_loo", "comparison", "report_facts", "run_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    warnings.simplefilter("ignore")
    spark = local_session(cpus, "bench", shuffle_partitions=cpus)
    QUERIES["target_kpis"](spark, sf_dir).collect()  # start-up is not a query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
