"""Fill-in-the-middle: texts cut at two units and written as prefix, suffix and middle, by one match each.

A text is matched once, whole, against ``(unit)*``. The regex library keeps every repetition of the
group, so ``match.ends(1)`` holds the end of each unit: its length is the number n of units, and the two
cuts are two of its entries. Nothing walks over the units.

The cuts come from the hex SHA-256 of ``SEED:`` followed by the decimal document id, whose first four
8-digit groups are h1 to h4. Prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, middle
after the larger; the rest is suffix. A document is left plain if h3 % 100 is not below ``share``, if its
text is empty, or if it holds one of the three marks, so that what is written can always be read back;
else it is ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) if h4 % 100 is below ``spm_share``, and
``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) otherwise.

A missing text is empty, a missing id has no digits. Repeated rows give equal rows. An empty table gives
none. Only doc_id and text are read, whatever other columns there are. Every text is one value in memory;
results leave a task in pieces of about ``BYTES_PER_BATCH``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
BYTES_PER_BATCH = 16 << 20


class Marks(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _checked(marks: Marks) -> Marks:
    """Marks that can be found again: none overlaps another or itself, or is empty."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlap = any(b.startswith(a[k:]) for k in range(1, len(a)))
            if not a or overlap or (i != j and a in b):
                raise ValueError(f"marks {a!r} and {b!r} cannot be told apart in a text")
    return marks


def unit_ends(pattern: regex.Pattern, text: str) -> list[int]:
    """Where each unit of the text ends, in code points."""
    match = pattern.fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover a text")
    return match.ends(1)


def fill_in_middle(
    docs: DataFrame,
    unit: str = LINES,
    seed: int = SEED,
    share: int = 100,
    spm_share: int = 50,
    marks: Marks = Marks(),
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    ``unit`` is a pattern without groups of its own that no empty text matches and whose repetition
    covers every text.
    """
    marks = _checked(marks)
    pattern = f"({unit})*+"
    if regex.compile(pattern).groups != 1 or regex.fullmatch(unit, ""):
        raise ValueError("a unit has no groups and is never empty")
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", number.alias("number"), F.col("text").alias("text"))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(pattern)

        def made(number: str, text: str) -> tuple:
            ends = [0, *unit_ends(units, text)]
            n = len(ends) - 1
            digits = hashlib.sha256(f"{seed}:{number}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
            if not text or h3 % 100 >= share or any(m in text for m in marks):
                return n, "plain", None, None, text
            a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h4 % 100 < spm_share:
                form, parts = "spm", (marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle)
            else:
                form, parts = "psm", (marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle)
            return n, form, len(prefix), len(middle), "".join(parts)

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            numbers, texts = batch.column(1), batch.column(2)
            done, size, begin = [], 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                done.append(made(numbers[i].as_py(), text))
                size += len(text)
                if size >= BYTES_PER_BATCH or i == batch.num_rows - 1:
                    arrays = [pa.array(v, k) for v, k in zip(zip(*done), kinds)]
                    ids = batch.column(0).slice(begin, len(done))
                    yield pa.RecordBatch.from_arrays([ids, *arrays], columns)
                    done, size, begin = [], 0, i + 1

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(work, schema)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text again, from an output and its form. No part holds a mark, so each is found once."""
    p, s, m = (F.lit(x) for x in _checked(marks))

    def after(mark: Column) -> Column:
        return F.substr(output, F.instr(output, mark) + F.length(mark))

    def between(first: Column, second: Column) -> Column:
        start = F.instr(output, first) + F.length(first)
        return F.substr(output, start, F.instr(output, second) - start)

    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
