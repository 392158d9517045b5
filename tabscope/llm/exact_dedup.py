"""Exact duplicates against a persistent digest index, bucketed and sorted by digest.

The index is a table with one row per text ever seen: its digest, the document that stands for it,
and the batch that brought it. New data is digested, reduced to one row per digest, anti-joined with
the index by sort-merge (the index side is read in bucket order, without a shuffle) and appended.

Texts are equal when identical after lower-casing A to Z. A missing text counts as the empty text.
Of equal texts in one batch the row with the largest id stays; rows without an id stay only where no
row of the group has one. Of rows that repeat both id and text one stays. An empty batch adds nothing.
A hot group of copies is reduced inside each task before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.plans.scratch import materialise

DIGEST = "text_sha256"


def text_digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) and the digest of the normalised text."""
    keep = [c for c in docs.columns if c not in (text, DIGEST)] if keep is None else keep
    # Places, not names, tell the columns apart inside the task.
    numbered = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("digest")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            # lower() of bytes touches A to Z only.
            found = [
                hashlib.sha256((t or b"").lower()).hexdigest()
                for t in texts.cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, pa.string())], batch.schema.names)

    return numbered.mapInArrow(digest, numbered.schema).toDF(*keep, DIGEST)


class DigestIndex:
    """One row per known text: digest, keep_id, batch. Kept as a table bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], f"{DIGEST} string, keep_id {id_type}, batch string")
            self._append(empty)

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, DIGEST)
            .write.bucketBy(self.buckets, DIGEST)
            .sortBy(DIGEST)
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.table)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame, batch: str, id_column: str = "doc_id") -> None:
        """Append the texts that the index does not hold yet. Repeating a batch changes nothing."""
        groups = digests.groupBy(DIGEST).agg(F.max(id_column).alias("keep_id"))
        unseen = groups.join(self.rows().hint("merge"), DIGEST, "left_anti")
        self._append(unseen.select(DIGEST, "keep_id", F.lit(batch).alias("batch")))

    def verdicts(self, digests: DataFrame, batch: str, id_column: str = "doc_id") -> DataFrame:
        """A row per row of ``digests``: id, keep_id, group_size (in this batch), kept, digest.

        Equal (id, digest) rows travel as one row with a count until the end.
        """
        rows = materialise(digests.groupBy(id_column, DIGEST).agg(F.count("*").alias("copies")), "rows")
        sizes = digests.groupBy(DIGEST).agg(F.count("*").alias("group_size"))
        # Read by path: a plain shuffle join, whose hot keys adaptive execution can split.
        known = self.spark.read.schema(self.rows().schema).parquet(self.path)
        # Both are written, so that the join below starts from two plain shuffles: only then can a hot
        # digest be split.
        groups = materialise(sizes.join(known, DIGEST), "groups")
        number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("number")
        return (
            rows.join(groups.hint("merge"), DIGEST)
            .select("*", number)
            .select(
                id_column,
                "keep_id",
                "group_size",
                (
                    F.col(id_column).eqNullSafe(F.col("keep_id"))
                    & (F.col("batch") == F.lit(batch))
                    & (F.col("number") == 1)
                ).alias("kept"),
                DIGEST,
            )
        )


def keep_one_of_each(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The documents of a batch that stay, with all their columns; the index learns the batch."""
    digests = materialise(text_digests(docs, keep=["doc_id"]), "digests")
    index.add(digests, batch)
    stay = index.verdicts(digests, batch).filter("kept")
    # Numbers instead of names: a document may have a column of any name, those used here included.
    names = docs.columns
    numbers = [f"c{i}" for i in range(len(names))]
    numbered = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(names, numbers)], F.col("doc_id").alias("id"), F.col("text").alias("text")
    )
    tagged = text_digests(numbered, keep=[*numbers, "id"])
    found = stay.select(F.col("doc_id").alias("stay_id"), F.col(DIGEST).alias("stay_digest"))
    same = F.col("id").eqNullSafe(F.col("stay_id")) & (F.col(DIGEST) == F.col("stay_digest"))
    return tagged.join(found, same).dropDuplicates(["id", DIGEST]).select(*numbers).toDF(*names)
