"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Documents are encoded inside the tasks and counted by encoded length. From the histogram, the number of
documents and tokens at or above each length follow as suffix sums, and with them the total under any
truncation, the documents that fit, and every quantile, without another look at the texts.

A missing text has no tokens and counts as a document of length 0. An empty table has an empty
histogram: totals and truncated totals are 0 and quantiles are missing. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.tokenizing import BYTE_BPE, byte_encoding, vocabulary

LENGTHS_PER_GROUP = 1024


def token_lengths(docs: DataFrame, path: str | None = None, extra: int = 0) -> DataFrame:
    """doc_id and n_tokens: ids of the whole text plus ``extra`` (an end token, say)."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(BYTE_BPE, path))
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoding(content.value).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) + extra if t else extra for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length L that occurs, as a context limit:

    docs_at_least, tokens_at_least  documents of length >= L and their tokens
    docs_up_to                      documents that fit into L (the rank of the quantile that ends at L)
    truncated_tokens                tokens left when every document is cut at L
    share_up_to                     docs_up_to over all documents

    Lengths are summed in groups of ``LENGTHS_PER_GROUP``, which are shifted by the groups above them.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = histogram.withColumn("part", F.expr(f"n_tokens div {LENGTHS_PER_GROUP}"))
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    # One row per 1024 lengths.
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = parts.select(
        "part",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"docs": F.sum("n_docs").over(inside), "tokens": F.sum(tokens).over(inside)})
    summed = own.join(shifts, "part").select(
        "n_tokens",
        "n_docs",
        (F.col("docs") + F.col("docs_above")).alias("docs_at_least"),
        (F.col("tokens") + F.col("tokens_above")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    fit = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        fit.alias("docs_up_to"),
        cut.alias("truncated_tokens"),
        (fit / F.col("all_docs")).alias("share_up_to"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, from the first length above it."""
    all_tokens = sums.agg(F.max("tokens_at_least")).first()[0] or 0
    over = sums.filter(F.col("n_tokens") > limit).agg(
        F.max("docs_at_least").alias("docs"), F.max("tokens_at_least").alias("tokens")
    ).first()
    return all_tokens - (over["tokens"] or 0) + limit * (over["docs"] or 0)


def length_quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed."""
    return sums.filter(F.col("share_up_to") >= share).agg(F.min("n_tokens")).first()[0]
