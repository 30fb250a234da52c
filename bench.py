"""Runs the headline queries and prints one JSON line with their seconds.

The cohort is counted from the lines once for an application; ``cohort_cells`` is that time, and part of the sum.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from junctura.plans import registry
from junctura.sources.cohort import cohort, forget

HEADLINE = ("split_read_counts", "psi5_psi3", "theta", "jaccard_index", "filter_expression", "filter_variability", "beta_binomial_p_values", "site_fdr", "gene_level_p_values", "interval_join_any", "nonsplit_read_counting", "read_coverage", "known_junctions", "sample_correlation", "pca_fit")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    forget()
    began = time.time()
    cohort(spark, sf_dir)
    took = {"cohort_cells": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
