"""Superkmers and bucket counts over streams of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.operators.buckets import bucket_counts
from kmerweave.operators.superkmers import superkmers


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """(seq_id, seq) of Parquet files as they come."""
    return spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_superkmers(seqs: DataFrame, k: int, l: int, **options) -> DataFrame:
    """Superkmers of a stream: the batch operator holds no state between rows, so it is the same pass."""
    return superkmers(seqs, k, l, **options)


def stream_bucket_counts(seqs: DataFrame, k: int, l: int, **options) -> DataFrame:
    """Running bucket counts, for the complete or update output mode; the state is a row for each minimizer."""
    return bucket_counts(superkmers(seqs, k, l, **options), k)


def windowed_bucket_counts(seqs: DataFrame, k: int, l: int, time: str = "time", window: str = "10 minutes", late: str = "1 hour", **options) -> DataFrame:
    """Counts by time window and bucket of the sequences' own times; windows close when the watermark has passed them.

    The k-mer totals by minimizer need only the sequence, so its time is carried as the pass's id, in microseconds.
    """
    timed = seqs.withWatermark(time, late).select(F.unix_micros(F.col(time)).alias("seq_id"), "seq", F.col(time).alias("time"))
    sk = superkmers(timed, k, l, **options).withColumn("time", F.timestamp_micros("seq_id")).withWatermark("time", late)
    return sk.groupBy(F.window("time", window), "mint").agg(F.sum(F.col("size") - (k - 1)).cast("bigint").alias("kmers"))
