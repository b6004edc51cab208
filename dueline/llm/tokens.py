"""Tokens of texts inside a task: each distinct word of a block is encoded once.

A text is cut where its vocabulary is sure to cut it too, so the pieces can be encoded apart and the
library's own ids come out. What is cut off as a word is encoded by the tokenizers library; a table of
words known so far is kept while it is small.

* ``word_tokens``: for vocabularies that drop white space and lower the case (NFC, lower case, then
  words). Cuts at ASCII white space.
* ``byte_pretokens``: for byte-level vocabularies, where one space belongs to the word behind it.
  Cuts before a space, and around a line end, between two characters that are neither white space nor
  control characters.

In both, trailing signs behind a Latin letter or a digit are a word of their own (``.`` and ``,`` in
``byte_pretokens``), and words of Latin letters alone, which nothing before the merges changes or cuts, go
straight to the library's merges; this takes a third of the time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time, and where ids of single documents are made of them.
BLOCK_BYTES, ID_BYTES = 8 << 20, 2 << 20
#: A table that knows so many words forgets those it met once. Workers outlive their tasks, and so does what they know.
KNOWN_WORDS = 200_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable in
    Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(0x100)}


LETTERS = byte_letters()
#: Words that neither Unicode forms, lower case nor the cutting patterns change.
LOWER_WORD, CASED_WORD = re.compile("[a-zß-öø-ÿ]+"), re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Words of ASCII and Latin letters: each character's lower case is its own, and nothing composes.
LATIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
#: Signs that are cut from a letter or digit before them, if they end a word; no apostrophe, as "'s" is one piece,
#: and no sign of a special string.
SIGNS, BEFORE_SIGNS = r""".,!?;:#$%&*@+=~^_/\-"()[]{}`""", "[A-Za-z0-9À-ÖØ-öø-ÿ]$"


class WordTable:
    """Token ids of words by a vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already uses each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = (LOWER_WORD if self.tokenizer.normalizer else CASED_WORD).fullmatch
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}  # in the order of their places
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int64)  # in how many calls; halved when words are forgotten

    def forget(self) -> None:
        """Keeps the words that were met again, at most half a table of those met most often."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > KNOWN_WORDS // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: KNOWN_WORDS // 2]])
        words = list(self.known)
        self.known = {words[i]: place for place, i in enumerate(kept.tolist())}
        self.ids = spread(kept, self.lengths, self.ids)
        self.lengths, self.met = self.lengths[kept], self.met[kept] // 2

    def cut(self, run: str) -> list[str]:
        """The vocabulary's own pre-tokens of a run, which it gives for each of them alone too. Whole if
        the run may hold a special string, or if the text is changed before it is cut."""
        before = self.tokenizer.pre_tokenizer
        if before is None or self.tokenizer.normalizer or any(t in run for t in self.special):
            return [run]
        return [run[start:end] for _, (start, end) in before.pre_tokenize_str(run)]

    def count(self, words: list[str]) -> np.ndarray:
        """How many tokens each word has; nothing is remembered."""
        out, rest = np.zeros(len(words), np.int64), []
        merge = self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            if self.plain(w):
                out[i] = len(merge(w.encode().decode("latin-1").translate(LETTERS)))
            else:
                rest.append(i)
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            out[some] = [len(e) for e in self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)]
        return out

    def codes(self, words: list[str]) -> np.ndarray:
        """The place of each word in the table, which learns new ones."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        plain, rest = [], []
        for w in new:
            (plain if self.plain(w) else rest).append(w)
        merge = self.tokenizer.model.tokenize
        found = [[t.id for t in merge(w.encode().decode("latin-1").translate(LETTERS))] for w in plain]
        for at in range(0, len(rest), 20_000):
            some = self.tokenizer.encode_batch_fast(rest[at : at + 20_000], add_special_tokens=False)
            found += [e.ids for e in some]
        self.lengths = np.concatenate([self.lengths, np.array([len(x) for x in found], np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        known.update(zip(plain + rest, range(len(known), len(known) + len(new))))
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[codes] += 1
        return codes


@cache
def table(path: str) -> WordTable:
    """One table per worker and vocabulary."""
    return WordTable(path)


def spread(codes: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs of values that the codes name, one after the other."""
    starts = np.cumsum(lengths) - lengths
    own = lengths[codes]
    shift = starts[codes] - (np.cumsum(own) - own)
    return values[np.repeat(shift, own) + np.arange(own.sum())]


def bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def blocks(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """Slices of about BLOCK_BYTES, or of another size, each of one text at least."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // (size or BLOCK_BYTES)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(start, end - start)


def listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def without_tail(words: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
    """Words without trailing signs, which of them had such a tail, and these tails: a vocabulary that cuts
    words into letters, digits and signs always cuts between them."""
    core = pc.utf8_rtrim(words, SIGNS)
    core = pc.if_else(pc.match_substring_regex(core, BEFORE_SIGNS), core, words)
    cut = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(cut)
    return listed(core), where, [w[-n:] for w, n in zip(listed(words.take(pa.array(where))), cut[where].tolist())]


def word_tokens(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary
    # The vocabulary lowers the case. Other letters may compose otherwise in lower case, and special
    # strings count only as they are: those words stay.
    plain = pc.and_(pc.match_substring_regex(distinct, LATIN), pc.invert(pc.match_substring(distinct, "<|")))
    core, where, tails = without_tail(pc.if_else(plain, pc.utf8_lower(distinct), distinct))
    own, place = table(path), {"": 0}
    of_tail = [place.setdefault(t, len(place)) for t in tails]
    found = own.codes(core + list(place))
    both = np.stack([found[: len(core)], np.full(len(core), found[len(core)])], axis=1)
    both[where, 1] = found[len(core) :][of_tail]
    ids = spread(both.ravel(), own.lengths, own.ids)
    lengths = own.lengths[both].sum(1)
    codes = words.indices.to_numpy(zero_copy_only=False)
    at = bounds(lists.value_lengths().to_numpy(zero_copy_only=False))
    return spread(codes, lengths, ids), np.diff(bounds(lengths[codes])[at])


def joined(words: list[str], rough: set[str]) -> list[str]:
    """Words of one text, put together again where a cut between them is not sure."""
    out = [words[0]]
    for before, word in zip(words, words[1:]):
        if before in rough or word in rough:
            out[-1] += " " + word
        else:
            out.append(word)
    return out


def cut_word(word: str, before: str) -> list[str]:
    """Pre-tokens of a word that has ``before`` in front of it: cut at line ends between two printable
    characters, and before trailing points and commas."""
    lines = word.split("\n")
    if len(lines) > 1 and not all(x and x[0].isprintable() and x[-1].isprintable() for x in lines):
        return [before + word]
    out: list[str] = []
    for i, line in enumerate(lines):
        core = line.rstrip(".,")
        if not (core and core[-1].isascii() and core[-1].isalnum()):
            core = line
        out += [before + core] if i == 0 else ["\n", core]
        if len(core) < len(line):
            out.append(line[len(core) :])
    return out


def short_pretokens(texts: pa.Array, path: str, most: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """``byte_pretokens``, and runs of over ``most`` characters, such as paragraphs of scripts without
    spaces, cut by the vocabulary itself."""
    words, row, places, often = byte_pretokens(texts)
    if not any(len(w) > most for w in words):
        return words, row, places, often
    known: dict[str, int] = {}
    cuts = [[known.setdefault(p, len(known)) for p in (table(path).cut(w) if len(w) > most else [w])] for w in words]
    sizes = np.array([len(c) for c in cuts], np.int64)
    flat = np.fromiter(chain.from_iterable(cuts), np.int64)
    key = np.repeat(row, sizes[places]) * len(known) + spread(places, sizes, flat)
    key, where = np.unique(key, return_inverse=True)
    sums = np.bincount(where, np.repeat(often, sizes[places]), len(key)).astype(np.int64)
    return list(known), key // len(known), key % len(known), sums


def byte_pretokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of the texts, and how often each is in each text: row, place in the list
    and frequency, ordered by row."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary
    # Empty, or white space or a control character at an end.
    rough = pc.match_substring_regex(distinct, r"^$|^[\s\p{Z}\p{C}]|[\s\p{Z}\p{C}]$")
    codes = words.indices.to_numpy(zero_copy_only=False)
    at = bounds(lists.value_lengths().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    is_rough = np.diff(bounds(rough.to_numpy(zero_copy_only=False)[codes])[at]) > 0
    inner = ~is_rough[row]
    inner[at[:-1]] = False  # the first word of a text has no space before it

    places: dict[str, int] = {}

    def placed(pieces: list[str]) -> list[int]:
        return [places.setdefault(p, len(places)) for p in pieces]

    # Words with a space in front: each distinct one is cut once.
    n = len(distinct)
    used, own_n = np.unique(row[inner] * n + codes[inner], return_counts=True)
    seen = np.unique(used % n) if n else used
    names = listed(distinct.take(pa.array(seen)))
    cuts = [placed(cut_word(w, " ")) for w in names]
    sizes = np.array([len(c) for c in cuts], np.int64)
    flat = np.fromiter(chain.from_iterable(cuts), np.int64)
    code = np.searchsorted(seen, used % n) if n else used
    rows, found, often = [np.repeat(used // max(n, 1), sizes[code])], [spread(code, sizes, flat)], [np.repeat(own_n, sizes[code])]

    # First words, and texts in which a cut at a space is not always sure.
    odd = set(distinct.filter(rough).to_pylist())
    heads = listed(lists.flatten().take(pa.array(at[:-1])))
    for i, head in enumerate(heads):
        if is_rough[i]:
            first, *rest = joined(lists[i].as_py(), odd)
            own = placed([first, *(" " + p for p in rest)])
        else:
            own = placed(cut_word(head, ""))
        rows.append(np.full(len(own), i))
        found.append(np.array(own, np.int64))
        often.append(np.ones(len(own), np.int64))
    total = max(len(places), 1)
    key, where = np.unique(np.concatenate(rows) * total + np.concatenate(found), return_inverse=True)
    sums = np.bincount(where, np.concatenate(often), len(key)).astype(np.int64)
    return list(places), key // total, key % total, sums


def documents_of(
    batch: pa.RecordBatch, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], end_id: int
) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids with the end id) of each row of a batch with columns doc_id and text."""
    doc_ids, row = batch.column("doc_id").to_pylist(), 0
    for texts in blocks(batch.column("text"), ID_BYTES):
        ids, lengths = tokens(texts)
        at = bounds(lengths)
        for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
            own = np.empty(end - start + 1, np.int32)
            own[:-1], own[-1] = ids[start:end], end_id
            yield doc_ids[row], own
            row += 1
