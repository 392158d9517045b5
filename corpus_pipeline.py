"""From raw documents to packed training sequences, in stages that each write and reread their rows.

1. language_id: documents go whose text is in none of the languages that the labelled rows teach,
   by the share of n-grams that the likeliest language has.
2. exact_dedup: of equal texts (A to Z lower-cased) the row with the largest id stays.
3. simhash_near_dedup: of each group linked by fingerprints within 3 bits the smallest id stays.
4. decontaminate: documents go that hold a benchmark item with at most a fifth of its words edited.
5. packing: the ids of what is left, in sequences of at most 4096.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import decontaminate, exact_dedup, language_id, packing, simhash
from tabscope.plans.scratch import materialise, scratch_folder


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.with_usual_shares(docs, language_id.fit(docs))
    return language_id.keep_recognised(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "pipeline-index")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = path.rpartition("/")[2].replace("-", "_")
    index = exact_dedup.DigestIndex(spark, name, path, buckets, kind)
    return exact_dedup.keep_one_of_each(docs, index, "documents")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each_group(docs, width=3, radius=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", recognise_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: Fingerprints, edit distances and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences made from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
