"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from kmerweave.operators import hashed
from kmerweave.operators.superkmers import superkmers
from kmerweave.registry import QUERIES
from kmerweave.sources.sequences import reads
from kmerweave.storage import new_path

HEADLINE = ("superkmers_mspxor", "superkmers_sticky", "superkmers_msp", "superkmers_classical", "uhs_mspxor", "kmc2", "lexicographic_l8", "nthash_quarantine", "hash_minimizers", "candidates_sticky", "multi_minimizers_2", "bucket_counts", "bucket_histogram", "kmer_counts", "superkmers_with_n")

KERNELS = {
    "superkmers_mspxor": lambda df: superkmers(df, 31, 8),
    "superkmers_sticky": lambda df: superkmers(df, 31, 8, mode="sticky"),
    "nthash_quarantine": lambda df: hashed.quarantine(df, 31, 9),
    "candidates_sticky": lambda df: hashed.candidate_syncmers(df, 31, 9),
    "multi_minimizers_2": lambda df: hashed.multi_minimizers(df, 31, 9, 2),
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "64k"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bases = reads(spark, sf_dir).selectExpr("sum(length(seq))").first()[0]
    QUERIES["superkmers_mspxor"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # The kernels alone: over reads that stand in a table already.
    path = new_path(spark, "bench-reads")
    reads(spark, sf_dir).repartition(4 * int(cpus)).write.parquet(path)
    alone = {}
    for name, cut in KERNELS.items():
        began = time.perf_counter()
        cut(spark.read.parquet(path)).write.format("noop").mode("overwrite").save()
        alone[name] = round(time.perf_counter() - began, 3)
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    mb_s = {n: round(bases / 1e6 / took[n], 1) for n in HEADLINE if n != "superkmers_with_n"}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "bases": bases, "mb_per_s": mb_s, "written_reads": alone, "written_reads_mb_per_s": {n: round(bases / 1e6 / t, 1) for n, t in alone.items()}}))


if __name__ == "__main__":
    main()
