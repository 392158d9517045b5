"""Benchmark passages in documents: pigeonhole edit matching on words.

An item of m words may differ from a passage by up to k = floor(share * m) word insertions, deletions
and replacements. Cut into k + 1 pieces, at least one piece stands unchanged in every such passage.
Each document is searched once for all pieces of a block of items (Aho-Corasick over its normalised
text); a hit marks the stretch in which the item would lie, and Myers' bit-parallel distance, with
words as symbols and the item as a long bit vector, decides. Items go in blocks of bounded size, each
block passing over all documents, so what is sent to the tasks does not grow with the benchmark.

Words are runs of letters and digits, lower-cased. Items of fewer than ``least_words`` words are not
searched, 5 unless told otherwise: so short a text is no evidence. A missing text has no words. Items with equal words each
match on their own. Repeated document rows each report their matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EDIT_SHARE = 0.2  # a similarity of 0.8 or more
LEAST_WORDS = 5
ITEMS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 16_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces_of(words: list[str], budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 consecutive pieces of nearly equal length."""
    parts = budget + 1
    return [(len(words) * i // parts, len(words) * (i + 1) // parts) for i in range(parts)]


def best_match(item: list[str], stretch: list[str]) -> tuple[int, int]:
    """(distance, end) of the passage of ``stretch`` nearest to the item; the first such end.

    Myers' recurrence: bit i of the vectors says whether the edit distance grows or falls by one from
    item prefix i to i + 1. Python's integers give the vector any length.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    grows, falls, distance = full, 0, m
    best, end = m, 0
    for j, word in enumerate(stretch, 1):
        same = where.get(word, 0)
        diagonal = ((((same & grows) + grows) ^ grows) | same) | falls
        up = falls | (full & ~(diagonal | grows))
        down = grows & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        # No carry into the lowest bit: a passage may begin anywhere.
        up, down = up << 1, down << 1
        grows = full & (down | ~(diagonal | up))
        falls = up & diagonal & full
        if distance < best:
            best, end = distance, j
    return best, end


def passage(item: list[str], stretch: list[str]) -> tuple[int, int, int]:
    """(distance, start, end) of a nearest passage: its start is found from its end backwards."""
    distance, end = best_match(item, stretch)
    _, back = best_match(item[::-1], stretch[:end][::-1])
    return distance, end - back, end


class Finder:
    """The pieces of some items in one automaton."""

    def __init__(self, items: list[tuple], share: float, least_words: int = LEAST_WORDS):
        self.items, self.budgets = {}, {}
        self.automaton = ahocorasick.Automaton()
        hits: dict[str, list[tuple]] = {}
        for key, text in items:
            words = words_of(text)
            if len(words) < max(1, least_words):
                continue
            budget = int(share * len(words) + 1e-9)
            self.items[key], self.budgets[key] = words, budget
            for start, end in pieces_of(words, budget):
                hits.setdefault(f" {' '.join(words[start:end])} ", []).append((key, start, end - start))
        for piece, found in hits.items():
            self.automaton.add_word(piece, found)
        if hits:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple]:
        """(item, distance, first word, number of words) of the best passage for each item found."""
        words = words_of(text)
        if not self.items or not words:
            return
        line = f" {' '.join(words)} "
        spans: dict = {}
        word, at = 0, 0
        for end, found in self.automaton.iter(line):
            # The spaces up to the end of the hit tell the word after it.
            word += line.count(" ", at, end)
            at = end
            for key, offset, length in found:
                k = self.budgets[key]
                first = word - length - offset - k
                last = word - length - offset + len(self.items[key]) + k
                spans.setdefault(key, []).append((max(0, first), min(len(words), last)))
        for key, stretches in spans.items():
            best = None
            stretches.sort()
            joined = [list(stretches[0])]
            for first, last in stretches[1:]:
                if first <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], last)
                else:
                    joined.append([first, last])
            for first, last in joined:
                distance, start, stop = passage(self.items[key], words[first:last])
                if distance <= self.budgets[key] and (best is None or distance < best[0]):
                    best = (distance, first + start, stop - start)
            if best:
                yield (key, *best)


def item_blocks(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks that are bounded in number and size (a longer item is a block alone)."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        length = len(row["text"] or "")
        if block and (len(block) >= most_items or size + length > most_bytes):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += length
    if block:
        yield block


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    share: float = EDIT_SHARE,
    most_items: int = ITEMS_PER_BLOCK,
    most_bytes: int = BYTES_PER_BLOCK,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, n_words) for every document row and item
    that it holds, at its best passage (the first of equals); words count from 0."""
    doc, item = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", doc),
            T.StructField("item_id", item),
            *[T.StructField(c, T.LongType()) for c in ("distance", "item_words", "first_word", "n_words")],
        ]
    )
    kinds = [f.type for f in to_arrow_schema(schema)]
    out = None
    for block in item_blocks(items, most_items, most_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(list(enumerate(t for _, t in sent.value)), share, least_words)
            for batch in batches:
                found = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for key, distance, first, n in finder.matches(text):
                        found.append((i, sent.value[key][0], distance, len(finder.items[key]), first, n))
                rows, *others = zip(*found) if found else [()] * len(kinds)
                columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(c, k) for c, k in zip(others, kinds[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        part = docs.select("doc_id", "text").mapInArrow(work, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, least_words: int = LEAST_WORDS
) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    names = docs.columns
    text_at = names.index("text")
    rest = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for block in item_blocks(items, ITEMS_PER_BLOCK, BYTES_PER_BLOCK):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(list(enumerate(t for _, t in sent.value)), share, least_words)
            for batch in batches:
                texts = batch.column(text_at).to_pylist()
                yield batch.filter(pa.array([next(finder.matches(t), None) is None for t in texts], pa.bool_()))

        rest = rest.mapInArrow(work, rest.schema)
    return rest.toDF(*names)
