from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dueline.llm import tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD)
SIGNS = [*tokens.SIGNS, "'", "'s", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "\x7f", "…", "€"]
LETTERS = ["a", "Z", "é", "É", "ß", "ÿ", "Þ", "×", "÷", "ª", "µ", "7", "²", "İ", "Σ", "Ω", "é", "́", "̸", "日", "\U0001f600"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*SIGNS, *LETTERS, " ", "\n"]), max_size=20).map("".join), min_size=1, max_size=30))
def test_signs_and_latin_letters_are_cut_as_the_library_cuts(texts):
    ids, lengths = tokens.word_tokens(pa.array(texts), WORD)
    at = tokens.bounds(lengths)
    assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_words_with_signs_go_straight_to_the_merges():
    words = ["Étage%%%", "réré,", "ai***", "Zoé!?", "abc#", "naïve.$"]
    core, where, tails = tokens.without_tail(pa.array([w.lower() for w in words]))
    assert core == ["étage", "réré", "ai", "zoé", "abc", "naïve"] and all(map(tokens.LOWER_WORD.fullmatch, core))
    assert where.tolist() == list(range(6)) and tails == ["%%%", ",", "***", "!?", "#", ".$"]
    assert tokens.without_tail(pa.array(["rock'", "it's", "...", "a<|", "é日.", "-"]))[0] == ["rock'", "it's", "...", "a<|", "é日.", "-"]


@pytest.fixture
def fresh_table(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 100)
    tokens.table.cache_clear()
    yield tokens.table(WORD)
    tokens.table.cache_clear()


def test_words_that_come_again_are_kept_when_the_table_forgets(fresh_table):
    rng = random.Random(0)
    often = ["".join(rng.choices("abcdé", k=5)) for _ in range(30)]
    for i in range(40):
        words = often + [f"word{i}x{k}" for k in range(60)]
        codes = fresh_table.codes(words)
        assert len(set(codes.tolist())) == len(set(words)) and list(fresh_table.known.values()) == list(range(len(fresh_table.known)))
        ids = tokens.spread(codes, fresh_table.lengths, fresh_table.ids)
        assert np.split(ids, np.cumsum(fresh_table.lengths[codes])[:-1])[-1].tolist() == LIBRARY.encode(words[-1], add_special_tokens=False).ids
        assert len(fresh_table.known) <= 100 + len(words)
    fresh_table.forget()
    assert set(often) <= set(fresh_table.known) and len(fresh_table.known) <= 50
