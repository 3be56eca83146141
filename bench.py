"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assaykit.plans import registry  # noqa: E402
from assaykit.session import local_session  # noqa: E402

HEADLINE = [
    "exact_duplicate_scores",
    "statistical_outlier",
    "isolation_forest",
    "near_duplicate_exact",
    "near_duplicate_lsh",
    "knn_scores",
    "combine_scores",
    "scan_clean_core",
    "binary_metrics",
    "roc_curve",
    "stratified_split",
    "stratified_folds",
    "perturb_rows",
    "perturbation_manifest",
    "row_index",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    run = registry.queries()
    names = sys.argv[1:] or HEADLINE
    run["label_distribution"](spark, folder).collect()  # starts the session's workers
    seconds = {}
    for name in names:
        start = time.time()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
