"""Filter interaction audit: what each of several filters removes, in every order, by a potential.

Every document gets one bit for each filter that it fails. From then on only the number of documents for
each part and set of failed filters counts, at most 2^k rows a part. The removal game of a part gives to
a coalition S of filters v(S), the documents that fail one of them. Its Hart-Mas-Colell potential is

    P(empty) = 0,   P(S) = (v(S) + sum over i in S of P(S without i)) / |S|

and is computed over all 2^k coalitions from small to large, times k! so that it stays a whole number. The
Shapley value of a filter is the grand potential minus the potential without it; times k! that is the sum
of its removals over all orders. A step of an order needs no more than differences of coalitions: the
filter i after those of S removes v(S and i) - v(S).

Every document counts once, also if its row or its label is repeated: repeated label rows count as one, a
document without a label as neither good nor toxic. Repeated rows of documents are documents of their own.
A missing text is empty, a missing part the empty string. A missing id is neither smaller nor larger than
another, so the copy rule never removes it. An empty table has no parts and gives no rows. Other columns
are not read, whatever their names.

Copies of one text and rows of one id are counted together inside each task before they meet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.plans.scratch import materialise

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"  # few words, few distinct words, capitals, signs, copies of a text of smaller id
COPY = 1 << 4
MOST_FILTERS = 7  # 7! orders of 7 steps a part


def failed_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed): the bits of the first four filters, and the text's digest for the fifth."""
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.col("text").alias("text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = re.compile(b"[" + re.escape(SIGNS) + b"]")
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            digests, failed = [], []
            for raw, length in zip(batch.column(2).cast(pa.binary()), chars):
                raw = raw.as_py() or b""
                words = raw.split()  # of bytes: at blanks and the five controls from tab to return
                capitals = len(raw) - len(raw.translate(None, CAPITALS))
                bits = (len(words) < LEAST_WORDS) | (
                    100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
                ) << 1
                bits |= (100 * capitals > MOST_CAPITALS_PERCENT * length) << 2
                bits |= (sign.search(raw) is not None) << 3
                digests.append(hashlib.sha256(raw).digest())
                failed.append(int(bits))
            arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "digest", "failed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, part string, digest binary, failed long")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic, each 0 or 1; several label rows of an id count as one."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality").eqNullSafe(1)).cast("long")).alias("good"),
        F.max((F.col("toxic").eqNullSafe(1)).cast("long")).alias("toxic"),
    )
    joined = rows.join(known, F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    return joined.fillna(0, ["good", "toxic"])


def profiles(rows: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and set of failed filters, copies included.

    Of each text and kind of document only counts travel, with the smallest id and the rows that have it.
    """
    kind = ["digest", "part", "failed", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    has_id = F.col("doc_id").isNotNull()
    first = F.min(F.when(has_id, F.struct("doc_id", "n")))
    counted = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("no_id"), first.alias("first")
    )
    # Of one text there are at most four rows a part here.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    is_first = F.col("first.doc_id") == F.col("least")
    stay = F.col("no_id") + F.coalesce(F.when(is_first, F.col("first.n")), F.lit(0))
    both = F.array(
        F.struct(F.col("failed"), stay.alias("n")),
        F.struct(F.col("failed").bitwiseOR(F.lit(COPY)).alias("failed"), (F.col("n") - stay).alias("n")),
    )
    split = counted.withColumn("least", least).select("part", "good", "toxic", F.explode(both).alias("x"))
    split = split.select("part", "good", "toxic", "x.failed", "x.n").filter("n > 0")
    return split.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    )


def potentials(v: np.ndarray) -> np.ndarray:
    """k! times the potential of every coalition; ``v`` has a row per game and a column per coalition."""
    size = v.shape[1]
    k = size.bit_length() - 1
    scale = factorial(k)
    out = np.zeros_like(v)
    for s in sorted(range(1, size), key=int.bit_count):
        smaller = [s ^ (1 << i) for i in range(k) if s >> i & 1]
        # Exact: (k! / |S|!) times an integer.
        out[:, s] = (scale * v[:, s] + out[:, smaller].sum(axis=1)) // len(smaller)
    return out


def _hit(coalition: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(coalition)) != 0


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counts`` has part, failed (bit i: fails the i-th filter), n, good, toxic.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    coalitions = range(1 << k)
    games = counts.groupBy("part").agg(
        F.sum("n").alias("all"),
        *[
            F.array(*[F.sum(F.when(_hit(s), F.col(c)).otherwise(0)) for s in coalitions]).alias(c)
            for c in ("n", "good", "toxic")
        ],
    )
    orders = list(permutations(range(k)))
    whole = (1 << k) - 1
    # By order and step: the filter, and the coalition before it.
    at = np.array([i for order in orders for i in order])
    before = np.array([sum(1 << i for i in order[:step]) for order in orders for step in range(k)])
    after = before | (1 << at)
    names = ["".join(filters[i] for i in order) for order in orders for _ in range(k)]
    steps = [step + 1 for _ in orders for step in range(k)]
    fields = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_pylist()
            totals = batch.column(1).to_pylist()
            n, good, toxic = (
                np.array(c.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(parts), 1 << k)
                for c in batch.columns[2:]
            )
            grand = potentials(n)
            shapley = grand[:, [whole]] - grand[:, whole ^ (1 << np.arange(k))]
            alone = n[:, [whole]] - n[:, whole ^ (1 << np.arange(k))]
            for row, (part, total) in enumerate(zip(parts, totals)):
                removed = n[row, after] - n[row, before]
                values = [
                    total - n[row, after],
                    removed,
                    n[row, 1 << at] - removed,
                    alone[row, at],
                    good[row, after] - good[row, before],
                    toxic[row, after] - toxic[row, before],
                    shapley[row, at],
                ]
                arrays = [pa.array([part] * len(at), pa.string()), pa.array(names), pa.array(steps, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *[pa.array(v, pa.int64()) for v in values]], ["part", "filter_order", "step", *fields]
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in fields)
    return games.mapInArrow(work, schema)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents, by source."""
    rows = materialise(failed_filters(docs), "failed-filters")
    return audit(materialise(profiles(with_labels(rows, labels)), "filter-profiles"))
