import numpy as np

from tabscope.llm import token_counts
from tabscope.llm.queries import QUERIES
from tabscope.llm.token_counts import length_histogram, length_quantile, suffix_sums, token_lengths, truncated_total
from tabscope.llm.tokenizing import BYTE_BPE, byte_encoding, vocabulary

ROWS = [(1, "one two three"), (2, None), (3, ""), (3, ""), (4, "<|endoftext|> é 水"), (5, "word " * 3000), (None, "one two three")]


def brute(lengths):
    lengths = np.array(lengths)
    out = {}
    for limit in set(lengths.tolist()):
        at_least = lengths[lengths >= limit]
        up_to = int((lengths <= limit).sum())
        out[limit] = (
            int((lengths == limit).sum()), len(at_least), int(at_least.sum()), up_to,
            int(np.minimum(lengths, limit).sum()), up_to / len(lengths),
        )
    return out


def test_query_equals_brute_force(spark, folder):
    encode = byte_encoding(vocabulary(BYTE_BPE)).encode_ordinary
    rows = QUERIES["op1_token_counts"](spark, folder(*ROWS)).collect()
    want = brute([len(encode(t or "")) + 1 for _, t in ROWS])
    assert {r.n_tokens: tuple(r)[1:] for r in rows} == want


def test_sums_over_many_groups(spark, monkeypatch):
    r = np.random.default_rng(4)
    lengths = r.integers(0, 9000, 3000).tolist()
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    for width in (1, 7, 1024):
        monkeypatch.setattr(token_counts, "LENGTHS_PER_GROUP", width)
        sums = suffix_sums(length_histogram(df))
        assert {x.n_tokens: tuple(x)[1:] for x in sums.collect()} == brute(lengths)
    sums = sums.cache()
    for limit in (0, 1, 513, 4096, 8999, 20_000):
        assert truncated_total(sums, limit) == int(np.minimum(lengths, limit).sum())
    for q in (0.01, 0.5, 0.9, 1.0):
        assert length_quantile(sums, q) == int(np.quantile(lengths, q, method="inverted_cdf"))


def test_empty_table(documents):
    sums = suffix_sums(length_histogram(token_lengths(documents())))
    assert sums.collect() == [] and truncated_total(sums, 10) == 0 and length_quantile(sums, 0.5) is None


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id int, text string, n_tokens int")
    assert [tuple(r) for r in token_lengths(docs).collect()] == [(1, 2)]
