import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlake.llm.automaton import Automaton, byte_alphabet, compile_merges
from barlake.llm.encode import PATTERN, VOCABULARY, count_tokens, decode_ids, encode_texts, splitter

regex = pytest.importorskip("regex")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, ids string, k int, tokens string"


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def automaton():
    return Automaton(compile_merges(VOCABULARY))


def encode(automaton, text):
    words = splitter()(text)
    assert words == regex.findall(PATTERN, text)
    return [i for w in words for i in automaton.encode(w.encode())]


TEXTS = ["", " ", "<|endoftext|>", "It's we'll I'd'", "a\n\n  b\t\tc   ", "naïve 日本語 🎉👩‍👩‍👧 𝛼β̂ ﬁ", "x" * 5000, "ab" * 4000, "0123456789" * 300, "\x00\x01\x7f​﻿", "QLKGJawa0R/nfL3qWKd0SkGYsnjiaHI+9tcxWkiWABHamQ", "    def f(x):\n        return {k: min(x, 3) for k in x}\n", "\r\n\r\n", "ĠĊ"]


def test_known_texts(automaton, reference):
    for t in TEXTS:
        ids = encode(automaton, t)
        assert ids == reference(t), t[:40]
        assert automaton.decode(ids).decode() == t


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinorst '", max_size=40), st.text(alphabet="aA1 \n\t\r\x0b\x1c\x85\xa0'sé", max_size=40)))
def test_any_text(automaton, reference, text):
    assert encode(automaton, text) == reference(text)


def test_every_token_reads_as_itself_and_arcs_match_pairs(automaton, reference):
    """A pair of tokens is joined by an arc if and only if their text is read as that pair (inside one word)."""
    r = random.Random(5)
    letters = [(i, t) for i, t in enumerate(automaton.t.labels) if t and t.isalpha() and t.isascii()]
    for i, t in r.sample(letters, 300):
        assert automaton.encode(t) == (i,)
    for _ in range(1500):
        (a, x), (b, y) = r.choice(letters), r.choice(letters)
        assert automaton.has_arc(a, b) == (reference((x + y).decode()) == [a, b]), (x, y)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(min_size=1, max_size=20), st.text(alphabet="abcdeXYZ019+/", min_size=1, max_size=70)), max_size=40))
def test_many_words_at_once(automaton, words):
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    assert [list(np.frombuffer(b, np.int32)) for b in automaton.encode_many(raw)] == [list(automaton.encode(w)) for w in raw]


def test_arcs_of_pairs_are_those_of_has_arc(automaton, monkeypatch):
    r = np.random.default_rng(4)
    known = np.array([i for i, t in enumerate(automaton.t.labels) if t])
    a, b = r.choice(known, 3000), r.choice(known, 3000)
    want = [automaton.has_arc(int(x), int(y)) for x, y in zip(a, b)]
    for _ in range(2):  # decided, then looked up
        assert automaton._arcs_open(a, b).tolist() == want


def test_alphabet_is_one_to_one():
    assert len(byte_alphabet()) == 256 == len(set(byte_alphabet().values()))


def test_tables(spark, reference):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(100, None, "x", 1, "y"), (None, "null id", "x", 1, "y"), (0, "again", "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = encode_texts(df)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    want = sorted((-1 if r[0] is None else r[0], reference(r[1] or "")) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in out.collect()) == want
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.tokens) for r in count_tokens(df, ["doc_id"]).collect()) == [(i, len(x)) for i, x in want]
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in decode_ids(out).collect())
    assert texts == sorted((-1 if r[0] is None else r[0], r[1] or "") for r in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert encode_texts(df).count() == count_tokens(df, ["doc_id"]).count() == decode_ids(encode_texts(df)).count() == 0
