"""Language identification: word frequencies first, shorter and shorter character n-grams for the rest.

A word that training saw scores its log frequency in every language. A word it did not see scores the
mean log frequency of those of its longest character n-grams that are known: five characters first,
then four, down to one. A document gets the language with the highest sum; its score is the share of
that language after normalising the likelihoods (0 to 1). Ties go to the language with more training
documents, then to the smaller label.

The classifier is fitted on a bounded sample of labelled rows: at most ``DOCS_PER_LANGUAGE`` whole
documents of each language, chosen by a hash of their id, of which ``MAX_WORDS`` (language, word) pairs and
``MAX_GRAMS`` (language, n-gram) pairs are kept: of each language its most frequent ones, ties by the item. The
languages share a bound evenly, and what one does not use goes to the others. Of more than
``MAX_LANGUAGES`` labels those with most documents count. These bounds also bound what is broadcast. Prediction reads every row and the whole text.

Whether a text is in a learned language at all is not a matter of those shares, which some language
always wins, but of the n-grams themselves: of the winner's learned n-grams of ``FAMILIAR_GRAM`` characters
the text must hold at least ``LEAST_KNOWN`` of the share that is usual in that language. What is usual is the
median over documents of the sample, each held against what the others taught.

A missing text or one without a letter is ``und`` with score 0. A text whose n-grams are all unknown
gets the language with most training documents. Rows without a language are not learned from.
Without any labelled row all texts are ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.plans.local import keep_rows
from tabscope.plans.scratch import materialise

DOCS_PER_LANGUAGE = 2000
MAX_LANGUAGES = 500
MAX_WORDS = 200_000
MAX_GRAMS = 300_000
LONGEST_GRAM = 5
FAMILIAR_GRAM = 4  # n-grams that tell a learned language from others; a shorter word counts as one
RARE = 5e-6  # an n-gram with a smaller share of a language's n-grams may come from foreign words in it
LEAST_KNOWN = 0.7  # of the share of known n-grams that is usual in a language
LEAST_SHARE = 0.25  # of n-grams that must be known where a language has too few documents to tell
USUAL_DOCS = 200  # documents of each language that tell the usual share
CACHED_WORDS = 100_000  # unseen words whose scores a task remembers at a time

UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    prior: list[float]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    gram_sums: np.ndarray  # by size and language, what a count was divided by before the logarithm
    usual: list[float] | None = None  # share of known n-grams by language; None stands for all


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def _grams(word: str, n: int) -> list[str]:
    """A word's n-grams, its ends marked by blanks; a blank alone says nothing and is none."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _familiar_grams(word: str) -> list[str]:
    return _grams(word, min(FAMILIAR_GRAM, len(word) + 2))


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the documents of each language whose id has the smallest hash."""
    rank = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    labelled = docs.filter("lang IS NOT NULL").select("lang", "text", rank.alias("rank"))
    order = Window.partitionBy("lang").orderBy("rank")
    # The rank of the last document to take; a language with fewer documents gives its largest rank.
    ranked = labelled.select("lang", "rank").withColumn("number", F.row_number().over(order))
    cut = ranked.filter(F.col("number") <= per_language).groupBy("lang").agg(F.max("rank").alias("cut"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    # One row per language, of which there are MAX_LANGUAGES at most.
    cuts = F.broadcast(keep_rows(cut.join(most, "lang").select("lang", "cut")))
    return labelled.join(cuts, "lang").filter("rank <= cut").select("lang", "text")


def _counted(frame: DataFrame, expand) -> DataFrame:
    """Sums of what ``expand`` counts in the rows of a batch, by (lang, item)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                expand(found, *row)
            langs = pa.array([k[0] for k in found], pa.string())
            items = pa.array([k[1] for k in found], pa.string())
            counts = pa.array(list(found.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([langs, items, counts], ["lang", "item", "n"])

    rows = frame.mapInArrow(work, "lang string, item string, n long")
    return rows.groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many items each language may keep: even shares, the smaller languages' rest for the larger."""
    found, left = {}, most
    for i, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        found[lang] = min(sizes[lang], left // (len(sizes) - i))
        left -= found[lang]
    return found


def _most_frequent(counted: DataFrame, most: int) -> pa.Table:
    """(lang, item, n): of each language the items with the largest counts, ties by item, ``most`` rows in all."""
    # One row for each language and count that occurs.
    rows = counted.groupBy("lang", "n").agg(F.count("*").alias("rows")).collect()
    by_count: dict[str, dict[int, int]] = {}
    for r in rows:
        by_count.setdefault(r["lang"], {})[r["n"]] = r["rows"]
    limits = []
    for lang, share in _shares({x: sum(c.values()) for x, c in by_count.items()}, most).items():
        left, least = share, None
        for n in sorted(by_count[lang], reverse=True):
            least = n
            if by_count[lang][n] >= left:
                break
            left -= by_count[lang][n]
        limits.append((lang, least, left))
    schema = "lang string, least long, left long"
    limited = counted.join(F.broadcast(counted.sparkSession.createDataFrame(limits, schema)), "lang")
    above = limited.filter("n > least").select("lang", "item", "n")
    # The items that share the last count: as many as the language has room for.
    order = Window.partitionBy("lang").orderBy("item")
    ties = limited.filter("n = least").withColumn("place", F.row_number().over(order))
    ties = ties.filter((F.col("place") <= F.col("left")) & (F.col("place") <= max(1, most)))
    return above.unionAll(ties.select("lang", "item", "n")).toArrow()


def _log_frequencies(
    kept: pa.Table, languages: list[str], totals: dict
) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Scores of kept items in every language, with half a count added to each, and the divisors."""
    items = kept.column("item").combine_chunks().dictionary_encode()
    index = {item: i for i, item in enumerate(items.dictionary.to_pylist())}
    place = {x: i for i, x in enumerate(languages)}
    langs = kept.column("lang").combine_chunks().dictionary_encode()
    columns = np.array([place[x] for x in langs.dictionary.to_pylist()], int)
    counts = np.full((len(index), len(languages)), 0.5)
    if len(index):
        at = (items.indices.to_numpy(), columns[langs.indices.to_numpy()])
        np.add.at(counts, at, kept.column("n").to_numpy())
    sums = np.array([totals.get(x, 0) for x in languages], float) + 0.5 * (len(index) + 1)
    return index, np.log(counts / sums), sums


def fit(
    docs: DataFrame,
    per_language: int = DOCS_PER_LANGUAGE,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> Model:
    """Learn from (doc_id, text, lang)."""
    sample = training_sample(docs, per_language)

    def count_words(found, lang, text):
        for w, n in Counter(_words(text)).items():
            found[lang, w] += n

    def count_grams(found, lang, word, times):
        # Grams of different lengths are told apart by their length.
        for n in range(1, LONGEST_GRAM + 1):
            for g in _grams(word, n):
                found[lang, g] += times

    words = materialise(_counted(sample, count_words), "words")
    grams = _counted(words.select("lang", "item", "n"), count_grams)
    grams = materialise(grams.withColumn("size", F.length("item")), "grams")
    sizes = docs.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    most_documents = sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    documents = {r["lang"]: r["n"] for r in most_documents.collect()}
    languages = sorted(documents, key=lambda x: (-documents[x], x))
    total_words = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    known = F.col("lang").isin(languages)
    index, scores, _ = _log_frequencies(_most_frequent(words.filter(known), max_words), languages, total_words)
    gram_index: dict[str, int] = {}
    gram_scores = [np.zeros((0, len(languages)))]
    gram_sums = []
    totals = grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()
    kept = _most_frequent(grams.filter(known), max_grams)
    sizes_of = pc.utf8_length(kept.column("item"))
    for size in range(1, LONGEST_GRAM + 1):
        own, found, sums = _log_frequencies(
            kept.filter(pc.equal(sizes_of, size)),
            languages,
            {r["lang"]: r["n"] for r in totals if r["size"] == size},
        )
        gram_index |= {g: i + len(gram_index) for g, i in own.items()}
        gram_scores.append(found)
        gram_sums.append(sums)
    everything = max(1, sum(documents.values()))
    prior = [float(np.log(documents[x] / everything)) for x in languages]
    return Model(
        languages, prior, index, scores, gram_index, np.concatenate(gram_scores), np.array(gram_sums)
    )


def with_usual_shares(docs: DataFrame, model: Model, per_language: int = USUAL_DOCS) -> Model:
    """The model of these documents with the median share of known n-grams in each language.

    The n-grams of a document are not counted for itself, as if it had not been learned from.
    """
    sent = _sent(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        place = {x: i for i, x in enumerate(scorer.model.languages)}
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            shares = [scorer.known_share(t, place[x], learned=True) for x, t in zip(langs, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], ["lang", "share"])

    # As many rows as documents are looked at, which come first in the order of the training sample.
    rows = training_sample(docs, per_language).mapInArrow(work, "lang string, share double")
    medians = rows.groupBy("lang").agg(F.median("share").alias("share")).collect()
    found = {r["lang"]: r["share"] for r in medians if r["share"] is not None}
    return model._replace(usual=[found.get(x, 0.0) for x in model.languages])


def _sent(docs: DataFrame, model: Model):
    """The model as plain lists, dicts and arrays: a broadcast names the classes of what it holds, and
    executors need not have this package."""
    return docs.sparkSession.sparkContext.broadcast(tuple(model))


class Scorer:
    """Sums of word scores by language, inside a task."""

    def __init__(self, model: Model):
        self.model = model
        self.known = len(model.words)
        self.index: dict[str, int] = {}  # unseen words that are remembered, behind the known ones
        self.cache = np.zeros((CACHED_WORDS, len(model.languages)))
        self.familiar: dict[int, dict[str, int]] = {}
        self._own: dict[int, bytes] = {}

    def unseen(self, word: str) -> np.ndarray:
        find = self.model.grams.get
        for n in range(LONGEST_GRAM, 0, -1):
            rows = [i for i in map(find, _grams(word, n)) if i is not None]
            if rows:
                return self.model.gram_scores[rows].mean(axis=0)
        return np.zeros(len(self.model.languages))

    def row(self, word: str) -> int:
        at = self.model.words.get(word)
        if at is None:
            at = self.index.get(word)
        if at is None:
            at = self.known + len(self.index)
            self.cache[len(self.index)] = self.unseen(word)
            self.index[word] = at
        return at

    def likelihoods(self, text: str | None) -> np.ndarray:
        total = np.array(self.model.prior)
        words = _words(text)
        for i in range(0, len(words), CACHED_WORDS // 2):
            part = words[i : i + CACHED_WORDS // 2]
            if len(self.index) + len(part) > len(self.cache):
                self.index.clear()
            at = np.fromiter(map(self.row, part), np.int64, len(part))
            seen = at < self.known
            total = total + self.model.word_scores[at[seen]].sum(axis=0) + self.cache[at[~seen] - self.known].sum(axis=0)
        return total

    def _counts(self, grams: list[str], language: int) -> tuple[np.ndarray, np.ndarray]:
        """How often training saw each n-gram in the language, and how often it must have."""
        sums = self.model.gram_sums[[len(g) - 1 for g in grams], language]
        at = [self.model.grams.get(g, -1) for g in grams]
        if not len(self.model.gram_scores):
            return np.zeros(len(grams)), np.ones(len(grams))
        counts = np.rint(np.exp(self.model.gram_scores[at, language]) * sums - 0.5)
        return np.where(np.array(at) < 0, 0, counts), np.maximum(1, RARE * sums)

    def _own_grams(self, language: int) -> bytes:
        """For each learned n-gram whether the language has it often enough, and a zero for all others; the
        n-grams are looked at once a task, not once a word."""
        if language not in self._own:
            counts, least = self._counts(list(self.model.grams), language)
            own = np.zeros(len(self.model.gram_scores) + 1, np.uint8)
            own[list(self.model.grams.values())] = counts >= least
            self._own[language] = own.tobytes()
        return self._own[language]

    def known_share(self, text: str | None, language: int, learned: bool = False) -> float | None:
        """The share of the text's n-grams that the language has; None if there are none.

        Of a learned text its own n-grams are taken off the counts first.
        """
        words = Counter(_words(text))
        known = total = 0
        if learned:
            own: Counter = Counter()
            for w, times in words.items():
                for g in _familiar_grams(w):
                    own[g] += times
            if own:
                times = np.array(list(own.values()))
                counts, least = self._counts(list(own), language)
                known, total = int(times[counts - times >= least].sum()), int(times.sum())
        else:
            own, place = self._own_grams(language), self.model.grams.get
            seen = self.familiar.setdefault(language, {})
            for w, times in words.items():
                found = seen.get(w)
                if found is None:
                    if len(seen) >= CACHED_WORDS // 2:
                        seen.clear()
                    grams = _familiar_grams(w)
                    # Both numbers in one: a cache of small tuples takes several times the memory.
                    found = seen[w] = sum([own[place(g, -1)] for g in grams]) << 32 | len(grams)
                known += (found >> 32) * times
                total += (found & 0xFFFFFFFF) * times
        return known / total if total else None

    def recognised(self, text: str | None, least_score: float) -> bool:
        """Whether one language has at least that share of the likelihood and the text's n-grams are its own."""
        found = self.likelihoods(text)
        best = int(found.argmax())
        if 1 / np.exp(found - found[best]).sum() < least_score:
            return False
        share = self.known_share(text, best)
        usual = 1.0 if self.model.usual is None else self.model.usual[best]
        return share is not None and share >= max(LEAST_SHARE, LEAST_KNOWN * usual)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row; only the text is looked at."""
    rows = docs.select("doc_id", "text", has_letter(F.col("text")).alias("letters"))
    sent = _sent(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        languages = scorer.model.languages
        for batch in batches:
            names, scores = [], []
            for text, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not letters or not languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                found = scorer.likelihoods(text)
                best = int(found.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(found - found[best]).sum()))
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of their id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out; predict all. doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_recognised(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text is in one of the model's languages by at least that share
    and has the n-grams of that language."""
    names = docs.columns
    sent = _sent(docs, model)
    numbered = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        has_letter(F.col("text")).alias("letters"),
    )
    text_at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            keep = []
            for text, letters in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()):
                keep.append(bool(letters and scorer.model.languages) and scorer.recognised(text, least_score))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return numbered.mapInArrow(work, numbered.schema).drop("letters").toDF(*names)
