"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run once to warm up and then ``$BENCH_RUNS`` times; the median counts.  Results go to the no-op
sink, so all rows and columns are produced and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortspark.plans.catalog import catalog  # noqa: E402
from cohortspark.session import build_session  # noqa: E402

HEADLINE = [
    # manifest
    "discover_series", "filter_series", "manifest", "conversion_summary",
    # text over whole documents
    "document_phase_text",
    # voxel statistics
    "tumor_metrics", "intensity_stats", "resample_linear",
    # components and lesions
    "connected_components_26", "lesion_catalog", "sampling_profile",
    # splits and patches
    "build_splits", "plan_patches",
    # evaluation
    "confusion_matrix", "auc_youden", "upsert_metrics", "reconstruction_quality",
    # cohort and curation
    "pair_images_masks", "patient_preprocess", "empty_dirs",
    # radiomics
    "firstorder_features", "glcm_counts", "glrlm_counts", "compare_groups",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY")
    spark = build_session(f"local[{cpus}]", 8, **{"spark.driver.memory": "8g"})
    times: dict[str, float] = {}
    for name in only.split(",") if only else HEADLINE:
        query = catalog()[name]

        def once() -> float:
            start = time.perf_counter()
            query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        once()
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
