from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dueline.llm import frame_of_reference, tokens
from dueline.llm.packing import assign, capacities, pack
from dueline.llm.token_counts import count_tokens
from dueline.llm.token_files import FileReader, read_files, write_files
from dueline.plans.shared import shared_folder
from tests.llm import brute
from tests.llm.conftest import ODD

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CLASH = {"start": 1, "n_tokens": "x", "ids": None, "sequence_id": 4}
PARTS = ["a", "B", "é", "É", " ", "  ", "\n", "\t", ".", ",", "'", "s", "1", " ", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "-", "\x1c", "\x85", "Σ", "İ", "J̌", " ", "ll", "\U0001f600", "日本"]


def library(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=40))
def test_tokens_are_the_librarys(texts):
    ids, lengths = tokens.word_tokens(pa.array(texts), WORD)
    at = tokens.bounds(lengths)
    assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == library(WORD, texts)
    words, row, places, often = tokens.byte_pretokens(pa.array(texts))
    pieces = tokens.table(BYTE).count(words)
    totals = np.bincount(row, often * pieces[places], len(texts))
    assert totals.tolist() == [len(x) for x in library(BYTE, texts)]
    assert len(set(words)) == len(words) and len({*zip(row.tolist(), places.tolist())}) == len(row)


def test_the_table_of_words_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 10)
    tokens.table.cache_clear()
    texts = ["".join(random.Random(i).choices("abc ", k=200)) for i in range(50)]
    for text in texts:
        assert tokens.word_tokens(pa.array([text]), WORD)[0].tolist() == library(WORD, [text])[0]
    tokens.table.cache_clear()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=3000))
def test_blocks_round_trip(values):
    values = np.array(values, np.uint32)
    blocks = frame_of_reference.encode(values)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype(np.int64) if blocks else np.empty(0, np.int64)
    back = frame_of_reference.decode(b"".join(blocks), starts) if blocks else np.empty(0, np.uint32)
    assert (back[: len(values)] == values).all() and len(back) - len(values) < frame_of_reference.BLOCK


def test_outliers_are_exceptions():
    values = np.arange(1024, dtype=np.uint32) % 8
    values[100] = 1 << 30
    assert len(frame_of_reference.encode(values)[0]) == 7 + 3 * 128 + 2 + 4


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_files_hold_all_ids_in_document_order(spark, make, monkeypatch):
    rows = ODD + [(i, f"text number {i} " * (i % 50)) for i in range(100, 300)]
    folder = shared_folder(spark, "token-files")
    manifest = write_files(make(rows, CLASH), folder, WORD, 1, partitions=4)
    got = sorted(read_files(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in by_id(rows)]
    start = 0
    seen: dict = {}
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), brute.crc(r.ids))
        start += r.n_tokens
        seen.setdefault(r.doc_id, []).append(r.ids)
    for doc_id in seen:
        texts = [t or "" for i, t in rows if i == doc_id]
        assert sorted(seen[doc_id]) == sorted(x + [1] for x in library(WORD, texts))
    # One document by itself, from the middle of a file.
    path, docs, _ = manifest[-1]
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        reader = FileReader(source)
        place = docs // 2
        assert reader.document(place).tolist() in seen[reader.doc_ids[place]]


def test_files_of_an_empty_table(spark, make):
    manifest = write_files(make([]), shared_folder(spark, "token-files"), WORD, 1, partitions=2)
    assert manifest == [] and read_files(spark, manifest).collect() == []


def test_counts(make):
    got = count_tokens(make(ODD, CLASH), BYTE, limit=12).collect()
    for common in (0, 2):  # all pre-tokens, or all but two, by the join
        assert sorted(map(repr, count_tokens(make(ODD, CLASH), BYTE, limit=12, common=common).collect())) == sorted(map(repr, got))
    expected = [(i, len((t or "").encode()), len(x), len(x) > 12) for (i, t), x in zip(ODD, library(BYTE, [t or "" for _, t in ODD]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert count_tokens(make([]), BYTE).collect() == []


#: Paragraphs without spaces, a special string in one, and runs that nothing cuts.
UNSPACED = [
    (1, "昨日は雨が降りました。今日は晴れです、明日も晴れるでしょう。" * 20),
    (2, "昨日は雨が降りました。今日は晴れです、明日も晴れるでしょう。" * 3000),
    (3, "ภาษาไทยไม่มีช่องว่าง" * 40),
    (4, "昨日は、" * 50 + "<|endoftext|>" + "今日は。" * 50),
    (5, "a1b2-c3/" * 90 + " it's " + "don't!!" * 60 + "\n\n\t" + "昨日。" * 70 + "\u3000\u3000" + "雨。" * 80),
    (6, "x" * 5000 + " " + "7" * 5000),
    (7, None),
]


def test_runs_without_spaces_are_counted_by_pretoken(make):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(make(UNSPACED), BYTE).collect()}
    assert got == {i: (len((t or "").encode()), len(x)) for (i, t), x in zip(UNSPACED, library(BYTE, [t or "" for _, t in UNSPACED]))}
    words, *_ = tokens.short_pretokens(pa.array([UNSPACED[1][1], UNSPACED[2][1]]), BYTE, 128)
    assert len(words) < 40 and max(map(len, words)) <= 128


def check_packed(rows, got, capacity):
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == brute.crc(r.ids) and r.length == len(r.ids) > 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    expected: dict = {}
    for (i, t), ids in zip(rows, library(WORD, [t or "" for _, t in rows])):
        expected.setdefault(i, []).append(ids + [2])
    seen: dict = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
    assert seen.keys() == expected.keys()
    for i, texts in expected.items():
        assert sum(r.length for r in seen[i]) == sum(map(len, texts))
        if len(texts) == 1:
            assert sum((list(r.ids) for r in sorted(seen[i], key=lambda r: r.start)), []) == texts[0]
            assert {r.doc_tokens for r in seen[i]} == {len(texts[0])}


def test_packed_without_padding(make):
    rows = ODD + [(i, f"text number {i} " * (i % 90)) for i in range(100, 400)]
    check_packed(rows, pack(make(rows, CLASH), WORD, 2, capacity=256).collect(), 256)
    assert pack(make([]), WORD, 2).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_balanced(seed):
    rnd = random.Random(seed)
    lengths = [min(20_000, int(rnd.lognormvariate(6, 1.3)) + 1) for _ in range(400)]
    pieces = assign(lengths, 4096, 1.0, 1 / 4096)
    assert sum(p[2] for p in pieces) == sum(lengths) == sum(capacities(sum(lengths), 4096))
    cost: dict = {}
    for _, _, n, seq, _ in pieces:
        if n < 4096:
            cost[seq] = cost.get(seq, 0) + n + n * n / 4096
    in_order: dict = {}
    at = 0
    for n in lengths:
        while n:
            part = min(n, 4096 - at % 4096)
            in_order[at // 4096] = in_order.get(at // 4096, 0) + part + part * part / 4096
            at, n = at + part, n - part
    full = [c for s, c in cost.items() if s < sum(lengths) // 4096]
    assert np.std(full) < np.std(list(in_order.values()))


def test_ids_of_documents_are_made_in_small_blocks():
    texts = [f"word{i} " * 50_000 for i in range(12)]
    batch, seen = pa.record_batch({"doc_id": range(12), "text": texts}), []

    def own(block):
        seen.append(sum(len(t) for t in block.to_pylist()))
        return np.arange(len(block), dtype=np.int32), np.ones(len(block), np.int64)

    assert [i for i, _ in tokens.documents_of(batch, own, 2)] == list(range(12))
    # A block ends with the text that fills it, and what a worker remembers is bounded.
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= tokens.ID_BYTES + len(texts[-1]) and tokens.KNOWN_WORDS <= 200_000
