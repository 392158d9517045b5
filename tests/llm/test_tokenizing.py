from array import array

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabscope.llm import tokenizing
from tabscope.llm.tokenizing import WORD_BPE, WordBpe, vocabulary

ODD = [
    "", " ", "\n\n", "it's I'll WE'RE don't 'tis rock'n'roll", "a1b22 333,,,..!! _x_ __", "ÀÉÎõü ß ẞ straße",
    "é Å ́", "水 Ελλάς ΣΟΦΟΣ Иван İstanbul ǅ ﬁ", "<|endoftext|> <|startoftext|>x", " a b​c\x1cd\x85e",
    "tab\there\rand\x0bthere\x0c", "ª º µ × ÷ ¼ ² ٣", "x" * 5000, "é" * 3000, "a.b.c-d/e\\f", "😀👍🏽 a😀b", "\x00\x01\x7f\xff",
]


@pytest.fixture(scope="module")
def both():
    content = vocabulary(WORD_BPE)
    library = Tokenizer.from_str(content)
    library.encode_special_tokens = True
    return WordBpe(content), lambda t: array("I", library.encode(t, add_special_tokens=False).ids).tobytes()


def test_odd_texts_equal_the_library(both):
    for text in ODD:
        assert both[0].ids(text) == both[1](text), text
    assert both[0].ids(None) == b""


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \nabAB'sltéÉ.,1"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_equals_the_library(both, text):
    assert both[0].ids(text) == both[1](text)


def test_documents_equal_the_library(both):
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist():
        assert both[0].ids(text) == both[1](text)


def test_every_word_of_the_vocabulary_is_merged_as_the_library_does(both):
    import json

    words = [w[:-4] for w in json.loads(vocabulary(WORD_BPE))["model"]["vocab"] if w.endswith("</w>") and w.isascii()]
    text = " ".join(w for w in words if w.isalpha())
    assert both[0].ids(text) == both[1](text)


def test_forgetting_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(tokenizing, "_CHUNKS", 2)
    fresh = WordBpe(vocabulary(WORD_BPE))
    for text in ODD * 2:
        assert fresh.ids(text) == both[1](text)
