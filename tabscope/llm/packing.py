"""Packing token sequences into bins of fixed length by best fit and swap-based local search.

Documents are cut into pieces only where they exceed the capacity. Full pieces are sequences of their
own. The others go in blocks of bounded size to tasks: best fit decreasing first, then local search.
The emptiest bin is a donor: its pieces move into other bins' room, or are exchanged for one smaller
piece, or for two that are smaller together, of a bin that gets fuller by it. Every step raises the sum
of squared fills. A block ends when it has the least number of bins that its tokens allow, when nothing
improves, or when ``TRIES`` donors in a row could not be emptied.

Blocks are dealt out evenly whatever the ids, so repeated ids form no hot block; they grow in number,
not in size, with the input. A missing text is the end id alone. An empty table has no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.tokenizing import WORD_BPE, WordBpe, vocabulary
from tabscope.plans.scratch import materialise

CAPACITY = 4096
END_ID = 1
BLOCK = 16_384  # pieces that one task packs together
PAIRED = 64  # bins of more pieces take part in moves and exchanges of one for one only
TRIES = 16  # donors in a row that may stay partly filled before the search of a block ends


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and the end id, in pieces."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(WORD_BPE, path))
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(content.value)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.ids(text) + end
                for n, byte in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[byte : byte + 4 * capacity]
                    at.append(i)
                    piece.append(n)
                    start.append(byte // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the bin with the least room that takes it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            insort(rooms, (room - size, b))
    return bins


class LocalSearch:
    """Bins of a block under moves and exchanges that raise the sum of squared fills."""

    def __init__(
        self, sizes: np.ndarray, bins: list[list[int]], capacity: int, tries: int = TRIES, paired: int = PAIRED
    ):
        self.sizes, self.bins, self.capacity = sizes.astype(np.int64), bins, capacity
        self.tries, self.paired = tries, paired
        self.fill = np.array([int(self.sizes[b].sum()) for b in bins], np.int64)
        self.where = np.zeros(len(sizes), np.int64)
        for b, members in enumerate(bins):
            self.where[members] = b

    def put(self, piece: int, source: int, target: int) -> None:
        self.bins[source].remove(piece)
        self.bins[target].append(piece)
        self.where[piece] = target
        self.fill[source] -= self.sizes[piece]
        self.fill[target] += self.sizes[piece]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces that share a bin with room."""
        first, second = [], []
        for b in np.flatnonzero(self.fill < self.capacity):
            members = np.array(self.bins[b])
            if 2 <= len(members) <= self.paired:
                i, j = np.triu_indices(len(members), 1)
                first.append(members[i])
                second.append(members[j])
        empty = np.zeros(0, np.int64)
        return (np.concatenate(first), np.concatenate(second)) if first else (empty, empty)

    def step(self, donor: int, pairs: tuple[np.ndarray, np.ndarray]) -> bool:
        """One improving move or exchange that takes tokens out of the donor."""
        room = self.capacity - self.fill
        room[donor] = -1
        room[self.fill == 0] = -1
        for piece in sorted(self.bins[donor], key=lambda p: -self.sizes[p]):
            size = self.sizes[piece]
            fits = np.flatnonzero((room >= size) & (self.fill + size > self.fill[donor]))
            if len(fits):
                self.put(piece, donor, int(fits[room[fits].argmin()]))
                return True
        # A receiving bin takes at most its room, and enough to end up fuller than the donor was.
        least = self.fill[donor] - self.fill
        best, swap = 0, None
        most, over = room[self.where], least[self.where]
        for piece in self.bins[donor]:
            gain = self.sizes[piece] - self.sizes
            gain = np.where((gain > over) & (gain <= most), gain, 0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, swap = int(gain[at]), (piece, (at,))
        if swap is None:
            # Pairs that an earlier step has parted are no longer offered.
            together = self.where[pairs[0]] == self.where[pairs[1]]
            first, second = pairs[0][together], pairs[1][together]
            both = self.sizes[first] + self.sizes[second]
            most, over = room[self.where[first]], least[self.where[first]]
            for piece in self.bins[donor] if len(first) else []:
                gain = self.sizes[piece] - both
                gain = np.where((gain > over) & (gain <= most), gain, 0)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, swap = int(gain[at]), (piece, (int(first[at]), int(second[at])))
        if swap is None:
            return False
        piece, back = swap
        target = int(self.where[back[0]])
        for other in back:
            self.put(other, target, donor)
        self.put(piece, donor, target)
        return True

    def run(self) -> list[list[int]]:
        least = -(-int(self.sizes.sum()) // self.capacity)
        settled = self.fill >= self.capacity
        failed = 0
        while int((self.fill > 0).sum()) > least and failed < self.tries:
            open_bins = np.flatnonzero((self.fill > 0) & ~settled)
            if not len(open_bins):
                break
            donor = int(open_bins[self.fill[open_bins].argmin()])
            pairs = self.pairs()
            while self.fill[donor] > 0 and self.step(donor, pairs):
                # What was tried before may work now; squares only grow, so this ends.
                settled = self.fill >= self.capacity
            settled[donor] = True
            failed = 0 if self.fill[donor] == 0 else failed + 1
        return [b for b in self.bins if b]


def pack(sizes: np.ndarray, capacity: int = CAPACITY, tries: int = TRIES, paired: int = PAIRED) -> list[list[int]]:
    """Piece numbers by bin."""
    return LocalSearch(sizes, best_fit(sizes, capacity), capacity, tries, paired).run()


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, tries: int = TRIES, paired: int = PAIRED
) -> DataFrame:
    """The pieces with sequence_id and offset. Ids are unique, in no order.

    The search of a block ends at the least number of bins that its tokens need, or where ``tries``
    donors in a row could not be emptied; bins of more than ``paired`` pieces offer no two for one.
    """
    n = pieces.count()
    names = pieces.columns
    length_at = names.index("length")
    dealt = pieces.repartition(max(1, -(-n // block)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = task << 32

        def packed(table: pa.Table):
            nonlocal number
            sizes = table.column(length_at).to_numpy().astype(np.int64)
            order, sequence, offset = [], [], []
            full = np.flatnonzero(sizes >= capacity)
            rest = np.flatnonzero(sizes < capacity)
            bins = [[i] for i in full.tolist()]
            bins += [rest[b].tolist() for b in pack(sizes[rest], capacity, tries, paired)] if len(rest) else []
            for members in bins:
                place = 0
                for i in members:
                    order.append(i)
                    sequence.append(number)
                    offset.append(place)
                    place += int(sizes[i])
                number += 1
            out = table.take(pa.array(order, pa.int64()))
            out = out.append_column("sequence_id", pa.array(sequence, pa.int64()))
            return out.append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                want = block * 2 - sum(b.num_rows for b in held)
                held.append(batch.slice(0, want))
                batch = batch.slice(want)
                if sum(b.num_rows for b in held) >= block * 2:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from packed(pa.Table.from_batches(held))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(work, f"{fields}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(token_pieces(docs, capacity, path), "pieces")
    return pack_pieces(pieces, capacity).select(
        "doc_id", F.col("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )
