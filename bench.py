"""Time the headline queries: BENCH_SF_DIR (tables) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "smooth_hourly", "clip_to_bound", "grid_last", "grid_mean", "impute_grid", "zscore_grid", "pack_samples", "mask_cells",
    "split_ratio", "split_counts", "pick_random", "resample", "filter_by_tokens",
    "confusion_at", "roc_auc", "average_precision", "best_f1", "recall_point", "regression_metrics", "ovr_auc",
    "multiclass_report", "bootstrap_ci", "bootstrap_ci_cells", "loss_aggregates",
    "tfidf_embed", "knn_graph", "knn_graph_blocks", "centroids", "top_cohorts", "frontier", "reverse_lookup",
    "detect_cohorts", "partition_quality", "unigram_entropy", "greedy_walk", "greedy_walk_lazy", "retrieve", "retrieve_random",
    "prompt_entropy", "render_detail", "render_prompt", "parse_probability", "parse_letter_ad", "parse_letter_az",
    "option_probs", "fingerprint",
]


def main() -> None:
    import suite

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("cohortflow-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
