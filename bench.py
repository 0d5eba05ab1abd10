"""Time headline queries; prints one JSON line.

Every query runs once untimed and is then timed on a full evaluation of its
result (all columns, no sink).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "class_profile",
    "clean_text",
    "preprocess",
    "handcrafted",
    "parse_id_lists",
    "resolve_service_ids",
    "data_quality",
    "company_profile",
    "codes_by_class",
    "top_codes",
    "keyword_purity",
    "size_quantiles",
    "tfidf_top_terms",
    "tfidf_top_terms_by_class",
    "similar_letters",
    "similar_letters_batch",
    "embedding_similarity",
    "stratified_folds",
    "ratio_preserving_set",
    "parse_responses",
    "scaled_features",
    "score_with_coefficients",
    "comprehensive_metrics",
    "roc_auc",
    "paired_t_test",
    "wilcoxon_test",
    "run_summary",
    "logistic_training",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lettermill-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.lettermill.inputTasks", cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - start
        spark.catalog.clearCache()
        return seconds

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(run(name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
