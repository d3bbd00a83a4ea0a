"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Whatever other columns ``docs`` has
are passed on, under any name, as they go through a stage in one struct; a row of a null doc_id or text takes part as
the stage's operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm import decontaminate, near_dedup, packing, substrings, toxicity
from kmerweave.llm.common import quoted
from kmerweave.storage import new_path, remove, scratch

#: A document goes when its toxicity score is at least this.
TOXIC = 0.7


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs in one struct, with what tells them apart for a join: doc_id (a null as the least number) and a
    hash of the text."""
    return docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance score does not reject. The fit uses the labels' rows of ``docs``."""
    model = toxicity.train(docs, toxicity.table(spark, sf_dir, "labels"))
    return toxicity.rate(docs, model, keep=docs.columns).where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group that links of similarity 0.8 on five-word shingles join.
    Equal rows of one doc_id are one document and stay together."""
    found = near_dedup.near_duplicates(docs, words=5).where("kept").selectExpr("coalesce(doc_id, bigint('-9223372036854775808')) as id", "text_key as key").distinct()
    return _keyed(docs).join(found, ["id", "key"], "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 or more words that start earlier; a text that loses words is its other words
    joined by one space, with n_chars anew. Those that keep no words of theirs go."""
    cut = substrings.repeats(docs).where("size(removed) > 0").selectExpr("coalesce(doc_id, bigint('-9223372036854775808')) as id", "text_key as key", "kept").dropDuplicates(["id", "key"])
    out = _keyed(docs).join(cut, ["id", "key"], "left").where("kept is null or kept <> ''")
    row = F.col("row").withField("text", F.coalesce("kept", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType)))
    return out.select(row.alias("row")).select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    found = decontaminate.search(docs, decontaminate.table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.where("size(hits) = 0").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their ids, dealt to sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("decontamination", drop_benchmark_leaks), ("packing", pack_sequences)]

#: No stage but the third and fourth can be said in SQL, so the whole can't; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet beside the checkpoints and read again. When a stage is written, the tables that it
    made on its way and those of the stage before are removed; the last one's rows stay, as the result reads them."""
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = new_path(spark, f"corpus-{i}-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if was:
            remove(spark, was)
        docs, was = spark.read.parquet(path), path
    return docs
