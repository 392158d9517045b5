"""Quality rules in a bitmask ledger: every rule is evaluated once, policies and ablations read the bits.

The ledger has one row per document: what was measured in its text, and a long whose bit i is set if the
document fails the i-th rule. Rules are conditions over the measurements, in whole numbers, so they never
hang on rounding. A rule set has a version, and so has a policy: the mask of rules of which one failure
drops a document, and how many of the other rules it may fail. Policies are applied to the ledger by bit
operations, and ablations (what would stay if a rule were left out, which documents only it drops) need
no more than the number of documents for each set of bits.

Words are runs without blanks and the controls from tab to return. Measured are, for each text,

    n_words, word_chars     words, code points in them
    n_symbols, n_capitals   characters of #*$%&|<> and A to Z
    n_lettered              words with a letter A to Z in either case or any character beyond ASCII
    n_lines, n_dup_lines    lines with a word, and those of them equal to an earlier line
    n_repeat_words          words inside windows of ``WINDOW`` words that occur twice or more

Equal windows are found exactly: words get numbers, and windows of 2, 4 and 8 words the numbers of their
halves' pairs. A missing text has no words and fails the rule on few words. Repeated rows give equal rows,
an empty table none. Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_capitals", "n_lettered", "n_lines", "n_dup_lines", "n_repeat_words"
)


class Rule(NamedTuple):
    """``fails`` is a condition over the measurements; the name stands for it in policies."""

    name: str
    fails: str


class Policy(NamedTuple):
    """One failed rule of ``fatal`` drops a document; of the others it may fail ``tolerated``."""

    version: str
    fatal: Sequence[str]
    tolerated: int = 0


RULES_VERSION = "rules-1"
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "10 * n_capitals > 4 * word_chars"),
    Rule("few_lettered", "10 * n_lettered < 7 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
)
BASE = ("few_words", "repeated_words")
POLICY = Policy("policy-1", [r.name for r in RULES])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of that many words that occurs at least twice."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    width = 1
    while width < window and len(codes):
        step = min(width, window - width)  # a window as two that may overlap
        pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        found, codes = np.unique(pairs, return_inverse=True)
        width += step
        if len(found) == len(pairs):
            return 0
    again = np.bincount(codes)[codes] > 1
    starts = np.flatnonzero(again)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measured(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the measurements of every text, taken in one pass."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lettered = re.compile(rb"[A-Za-z\x80-\xff]")
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            out = []
            for raw, length in zip(batch.column(1).cast(pa.binary()), chars):
                raw = raw.as_py() or b""
                words = raw.split()  # of bytes: at the six blanks only
                lines = [line for line in raw.split(b"\n") if line.strip()]
                out.append(
                    (
                        len(words),
                        length - len(raw) + len(raw.translate(None, BLANKS)),
                        len(raw) - len(raw.translate(None, SYMBOLS)),
                        len(raw) - len(raw.translate(None, CAPITALS)),
                        sum(map(bool, map(lettered.search, words))),
                        len(lines),
                        len(lines) - len(set(lines)),
                        repeated_words(words, window),
                    )
                )
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def mask_of(names: Sequence[str], rules: Sequence[Rule]) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[name] for name in set(names))


def with_bits(measures: DataFrame, rules: Sequence[Rule] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """The ledger: the measurements, failed (a bit for each failed rule) and the rule set's version."""
    if not 0 < len(rules) <= 63 or len({r.name for r in rules}) < len(rules):
        raise ValueError("1 to 63 rules of different names")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0).cast("long"))
    return measures.select("*", bits.alias("failed"), F.lit(version).alias("rules_version"))


def keeps(policy: Policy, rules: Sequence[Rule] = RULES, failed: Column | None = None) -> Column:
    """Whether a document stays under a policy, from its bits."""
    failed = F.col("failed") if failed is None else failed
    fatal = mask_of(policy.fatal, rules)
    others = ((1 << len(rules)) - 1) & ~fatal
    tolerable = F.bit_count(failed.bitwiseAND(F.lit(others).cast("long"))) <= policy.tolerated
    return (failed.bitwiseAND(F.lit(fatal).cast("long")) == 0) & tolerable


def failed_any(names: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) != 0


def ablations(ledger: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy version and rule: documents, failing, alone (failing nothing else), kept, kept_without
    (were the rule left out). Documents are counted by their bits first; no text or document is read again.
    """
    counts = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    cases = []
    for policy in policies:
        for i, rule in enumerate(rules):
            without = F.col("failed").bitwiseAND(F.lit(~(1 << i)).cast("long"))
            cases.append(
                F.struct(
                    F.lit(policy.version).alias("policy"),
                    F.lit(rule.name).alias("rule"),
                    F.lit(i).alias("bit"),
                    keeps(policy, rules).alias("kept"),
                    keeps(policy, rules, without).alias("kept_without"),
                )
            )
    rows = counts.select("failed", "n", F.explode(F.array(*cases)).alias("x")).select("failed", "n", "x.*")
    bit = F.expr("shiftleft(1L, bit)")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return rows.groupBy("policy", "rule", "bit").agg(
        F.sum("n").alias("documents"),
        total(F.col("failed").bitwiseAND(bit) != 0).alias("failing"),
        total(F.col("failed") == bit).alias("alone"),
        total(F.col("kept")).alias("kept"),
        total(F.col("kept_without")).alias("kept_without"),
    )
