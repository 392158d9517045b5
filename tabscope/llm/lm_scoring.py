"""Log-probabilities of texts under a bigram model with deleted interpolation.

A token's probability mixes three estimates: its share after the previous token, its share among all
tokens, and an even share over all known types and one unknown. The weights depend on how often the
previous token was seen (in powers of two) and are learned by expectation-maximisation: part of the
training documents is set aside, estimates from the rest predict it, and the weights that make it most
likely stay. The scores then use the counts of all training documents.

Words are what stands between ASCII white space, with A to Z lower-cased; every text ends with one end
token and starts behind a start symbol that is never counted as a token. A missing text is the empty
text: its end token alone. Words are told apart by 64-bit hashes.

The corpus is copied once into blocks of bounded size. A block asks for the counts of the distinct
words and word pairs it holds: sorted keys, cut by their leading bits into ranges. One task per range
adds up the counts of all blocks and answers each in the order it asked, so an answer is counts alone.
A word or pair that is frequent everywhere is asked for once by each block; ranges are even because
keys are hashes. Blocks and ranges grow in number with the corpus, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabscope.plans.scratch import materialise

BLOCK_BYTES = 8_000_000  # text of a block; a longer document is a block of its own
RANGE_BYTES = 16_000_000  # text for which one more range of keys is opened
RANGES_PER_BATCH = 4096  # of one block, sent on together
DELETED = 10  # one training document in so many is set aside to learn the weights

PLAIN_BYTES, _PLAIN = 128, 1 << 63  # so few bytes are not worth compressing; marks them in the length

MAIN, ASIDE, OUTSIDE = 0, 1, 2  # folds: counted, set aside, not for training
WORD, PAIR = 0, 1

_END = np.uint64(xxhash.xxh3_64_intdigest(b""))  # no word is empty
_START = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word has a blank


def _packed(values: np.ndarray) -> bytes:
    """An array as bytes: first its length, then its byte planes, compressed unless they are few."""
    raw = np.ascontiguousarray(values)
    if raw.nbytes <= PLAIN_BYTES:
        return (len(raw) | _PLAIN).to_bytes(8, "little") + raw.tobytes()
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if n & _PLAIN:
        return np.frombuffer(data, kind, offset=8).copy()
    planes = pa.decompress(data[8:], n * size, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def text_blocks(docs: DataFrame, fold: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, fold, size, payload): doc_id and text of some rows of one fold as compressed Arrow data."""
    rows = docs.select("doc_id", "text", fold.cast("int").alias("fold"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.RecordBatch]] = {}
        sizes: dict[int, int] = {}

        def block(fold: int) -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            parts = held.pop(fold)
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, parts[0].schema, options=options) as writer:
                for part in parts:
                    writer.write_batch(part)
            number += 1
            name = f"{task}-{number}"
            return pa.RecordBatch.from_pydict(
                {"block": [name], "fold": pa.array([fold], pa.int32()), "size": [sizes.pop(fold)], "payload": [sink.getvalue().to_pybytes()]}
            )

        for batch in batches:
            folds = batch.column(2).to_numpy()
            texts = batch.select([0, 1])
            lengths = texts.column(1).cast(pa.binary())
            lengths = np.array([len(t) if t else 0 for t in lengths.to_pylist()], np.int64) + 1
            for fold in np.unique(folds).tolist():
                at = np.flatnonzero(folds == fold)
                while len(at):
                    room = block_bytes - sizes.get(fold, 0)
                    fit = max(0 if fold in held else 1, int(np.searchsorted(np.cumsum(lengths[at]), room, "right")))
                    if fit:
                        held.setdefault(fold, []).append(texts.take(pa.array(at[:fit])))
                        sizes[fold] = sizes.get(fold, 0) + int(lengths[at[:fit]].sum())
                        at = at[fit:]
                    if len(at) or sizes[fold] >= block_bytes:
                        yield block(fold)
        for fold in list(held):
            yield block(fold)

    return rows.mapInArrow(work, "block string, fold int, size long, payload binary")


class Tokens:
    """A block's documents as token hashes: words and end tokens, each with its predecessor."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all()
        self.ids = table.column(0)
        digest = xxhash.xxh3_64_intdigest
        parts, lengths = [], []
        for batch in table.to_batches():
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                parts.append(_END)
                lengths.append(len(words) + 1)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.token = np.hstack(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.starts] = _START

    def pairs(self) -> np.ndarray:
        """A hash of each (predecessor, token)."""
        with np.errstate(over="ignore"):
            x = self.before * np.uint64(0x9E3779B97F4A7C15) ^ (self.token << np.uint64(1) | self.token >> np.uint64(63))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def words(self) -> np.ndarray:
        """Tokens, and one start symbol for each document: what predecessors are counted by."""
        return np.concatenate([self.token, np.full(len(self.lengths), _START)])


def _by_range(
    keys: np.ndarray, counts: np.ndarray | None, bits: int
) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """The sorted keys of a block by range, with their counts if there are any: (ranges, keys, counts) of up to
    ``RANGES_PER_BATCH`` ranges that have a key. Work grows with these, not with the number of ranges."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    ends = np.append(starts[1:], len(keys))
    for first in range(0, len(starts), RANGES_PER_BATCH):
        some = slice(first, first + RANGES_PER_BATCH)
        spans = list(zip(starts[some].tolist(), ends[some].tolist()))
        sums = [b""] * len(spans) if counts is None else [_packed(counts[s:e].astype(np.uint32)) for s, e in spans]
        yield at[starts[some]], [_pack_keys(keys[s:e]) for s, e in spans], sums


def _asked(blocks: DataFrame, bits: int) -> DataFrame:
    """(range, block, fold, kind, keys, counts): distinct keys of each block and how often they occur."""
    schema = "range int, block string, fold int, kind int, keys binary, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Tokens(row["payload"])
                for kind, values in ((WORD, tokens.words()), (PAIR, tokens.pairs())):
                    keys, counts = np.unique(values, return_counts=True)
                    for at, parts, sums in _by_range(keys, counts if row["fold"] != OUTSIDE else None, bits):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(at, pa.int32()),
                                pa.array([row["block"]] * n, pa.string()),
                                pa.array(np.full(n, row["fold"], np.int32)),
                                pa.array(np.full(n, kind, np.int32)),
                                pa.array(parts, pa.binary()),
                                pa.array(sums, pa.binary()),
                            ],
                            ["range", "block", "fold", "kind", "keys", "counts"],
                        )

    return blocks.select("block", "fold", "payload").mapInArrow(work, schema)


def _answered(asked: DataFrame) -> DataFrame:
    """The corpus counts of every key asked for, and the totals of each range.

    (range, block, fold, kind, main, aside): counts in the order of the block's keys. A row without a
    block has the range's totals: tokens and types in the main fold and in both training folds.
    """
    schema = (
        "range int, block string, fold int, kind int, main binary, aside binary, "
        "tokens long, types long, main_tokens long, main_types long"
    )

    def work(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = table.select(["range", "block", "fold", "kind"]).to_pylist()
        for kind in (WORD, PAIR):
            own = [i for i, r in enumerate(rows) if r["kind"] == kind]
            if not own:
                continue
            keys = [_unpack_keys(table.column("keys")[i].as_py()) for i in own]
            known, place = np.unique(np.concatenate(keys), return_inverse=True)
            ends = np.cumsum([len(k) for k in keys])
            sums = np.zeros((2, len(known)), np.int64)
            for i, k, e in zip(own, keys, ends):
                if rows[i]["fold"] != OUTSIDE:
                    # A block's keys are distinct, so plain indexing adds each once.
                    sums[rows[i]["fold"], place[e - len(k) : e]] += _unpacked(table.column("counts")[i].as_py(), np.uint32)
            for i, k, e in zip(own, keys, ends):
                r = rows[i]
                found = sums[:, place[e - len(k) : e]].astype(np.uint64)
                out.append((r["range"], r["block"], r["fold"], kind, _packed(found[MAIN]), _packed(found[ASIDE]), None, None, None, None))
            if kind == WORD:
                real = sums[:, known != _START]
                both = real.sum(axis=0)
                totals = (int(both.sum()), int((both > 0).sum()), int(real[MAIN].sum()), int((real[MAIN] > 0).sum()))
                out.append((rows[own[0]]["range"], None, None, kind, None, None, *totals))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return asked.groupBy("range").applyInArrow(work, schema)


class Counts:
    """Corpus counts of a block's tokens, their pairs and their predecessors, in the given folds."""

    def __init__(self, tokens: Tokens, answers: pa.Table, folds: tuple[str, ...]):
        order = np.lexsort((answers.column("range").to_numpy(), answers.column("kind").to_numpy()))
        kinds = answers.column("kind").to_numpy()
        found = []
        for kind, values in ((WORD, tokens.words()), (PAIR, tokens.pairs())):
            keys, place = np.unique(values, return_inverse=True)
            own = [i for i in order if kinds[i] == kind]
            sums = sum(
                np.concatenate([np.zeros(0, np.uint64), *(_unpacked(answers.column(f)[int(i)].as_py(), np.uint64) for i in own)])
                for f in folds
            )
            if len(sums) != len(keys):
                raise ValueError("the answer does not fit the block")
            found.append((keys, sums.astype(np.float64), place))
        keys, sums, place = found[0]
        self.word = sums[place[: len(tokens.token)]]
        start = sums[place[len(tokens.token) :]][0] if len(tokens.lengths) else 0.0
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[tokens.starts] = start
        self.pair = found[1][1][found[1][2]]


def frequency_bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts not seen, else 1 + the power of two below the count."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _estimates(counts: Counts, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    pair = np.divide(counts.pair, counts.context, out=np.zeros_like(counts.pair), where=counts.context > 0)
    return pair, counts.word / max(1, tokens)


def _join(blocks: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each block's payload and its answers."""
    return (
        blocks.select("block", "payload")
        .groupBy("block")
        .cogroup(answers.filter("block IS NOT NULL").select("block", "range", "kind", "main", "aside").groupBy("block"))
        .applyInArrow(work, schema)
    )


def _evidence(blocks: DataFrame, answers: DataFrame, tokens: int) -> DataFrame:
    """Set-aside tokens by context bucket and rounded estimates: (bucket, n, pair, word), where pair
    and word are the sums of the two estimates. Their logarithms are rounded to quarters of a power
    of two, which bounds the rows; means keep the estimates exact inside a cell."""

    def cell(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.floor(np.log2(np.where(p > 0, p, 1)) * 4), -1000).astype(np.int64)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Tokens(left.column("payload")[0].as_py())
        counts = Counts(block, right, ("main",))
        pair, word = _estimates(counts, tokens)
        key = np.stack([frequency_bucket(counts.context), cell(pair), cell(word)])
        cells, place = np.unique(key, axis=1, return_inverse=True)
        place = place.ravel()
        return pa.table(
            {
                "bucket": pa.array(cells[0], pa.int32()),
                "x": pa.array(cells[1], pa.int32()),
                "y": pa.array(cells[2], pa.int32()),
                "n": pa.array(np.bincount(place), pa.int64()),
                "pair": np.bincount(place, pair),
                "word": np.bincount(place, word),
            }
        )

    cells = _join(blocks, answers, work, "bucket int, x int, y int, n long, pair double, word double")
    return cells.groupBy("bucket", "x", "y").agg(F.sum("n").alias("n"), F.sum("pair").alias("pair"), F.sum("word").alias("word"))


def mixture_weights(evidence: list, types: int, rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, even) by context bucket that make the set-aside tokens most likely.

    A bucket without set-aside tokens takes the weights of the nearest bucket below that has some.
    """
    weights = np.tile([0.4, 0.4, 0.2], (65, 1))
    weights[0] = [0.0, 0.8, 0.2]
    last = None
    for bucket in range(65):
        rows = [r for r in evidence if r["bucket"] == bucket]
        if not rows:
            if last is not None:
                weights[bucket] = last
            continue
        n = np.array([r["n"] for r in rows], float)
        p = np.array([[r["pair"] / r["n"], r["word"] / r["n"], 1 / (types + 1)] for r in rows])
        mix = weights[bucket]
        for _ in range(rounds):
            share = p * mix
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) / n.sum()
            done = np.abs(new - mix).max() < 1e-7
            mix = new
            if done:
                break
        # Something unseen always keeps a probability.
        mix = np.maximum(mix, [0.0, 0.0, 1e-6])
        weights[bucket] = mix / mix.sum()
        if bucket:
            last = weights[bucket]
    return weights


def training_fold(doc_id: Column) -> Column:
    """A fifth of the documents is not for training; one in ``DELETED`` of the others is set aside."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    aside = F.floor(crc / 5) % DELETED == 0
    return F.when(crc % 5 == 1, OUTSIDE).when(aside, ASIDE).otherwise(MAIN)


def score_documents(
    docs: DataFrame, fold: Column, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``fold`` says which rows train the model. base_score is that of single words with half a count
    added; score that of the mixture. Both are sums of log10. Without training rows, every known
    count is 0 and all texts score 0.
    """
    blocks = materialise(text_blocks(docs, fold, block_bytes), "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, (size // range_bytes).bit_length())
    answers = materialise(_answered(_asked(blocks, bits)), "counts")
    totals = answers.filter("block IS NULL").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "main_tokens", "main_types")]
    ).first()
    tokens, types = totals["tokens"], totals["types"]
    aside = answers.filter(F.col("fold") == ASIDE)
    cells = _evidence(blocks.filter(F.col("fold") == ASIDE), aside, totals["main_tokens"])
    weights = mixture_weights(cells.collect(), totals["main_types"])
    fields = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Tokens(left.column("payload")[0].as_py())
        counts = Counts(block, right, ("main", "aside"))
        pair, word = _estimates(counts, tokens)
        mix = weights[frequency_bucket(counts.context)]
        p = mix[:, 0] * pair + mix[:, 1] * word + mix[:, 2] / (types + 1)
        if not tokens:
            p = np.ones_like(p)
        base = np.log10((counts.word + 0.5) / (tokens + 0.5 * (types + 1)))
        return pa.table(
            {
                "doc_id": block.ids,
                "n_tokens": pa.array(block.lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts.word > 0).astype(np.int64), block.starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(block.lengths), tokens), pa.int64()),
                "base_score": np.add.reduceat(base, block.starts),
                "score": np.add.reduceat(np.log10(p), block.starts),
            }
        )

    schema = f"doc_id {fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _join(blocks, answers, work, schema)


def score_held_out(docs: DataFrame) -> DataFrame:
    """All documents, learned from those whose id falls into a training fold."""
    outside = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_documents(docs, training_fold(F.col("doc_id"))).select(
        "doc_id", outside.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
