"""Token ids of whole texts by a public tokenizer, word by word: a word's ids are looked up, and made only once.

The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words in a row.
A new word goes through the tokenizer's normalizer, its pattern and its byte-pair model; words
that hold a special token go through the whole tokenizer. Known words are found by 64-bit hashes of their bytes (of a million
words, two have the same hash with a probability of 3e-8).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer, pre_tokenizers

from gaugeframe.llm.common import mixed

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Fixed value: the pattern of the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
pieces = regex.compile(PATTERN).findall
#: The same for lower-case ASCII.
pieces_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
#: The same for lower-cased text below U+0250, which is its own normal form.
pieces_latin = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
BEYOND_LATIN = re.compile("[^\x00-\u024f]").search
#: A part that stands between words; words with control characters do not go together.
MARK = "\x01"
CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|\xc2[\x80-\x9f]").search


def byte_letters() -> dict[int, str]:
    """What byte-level models write for each byte: itself where it is printable, else the next free letter from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Letters of bytes, but for the space between parts.
LETTERS = {b: x for b, x in byte_letters().items() if b != 0x20}


#: Where words end.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: What a word of so many bytes leaves of eight.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 256


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the words of bytes that begin and end with a space."""
    space = SPACES.take(raw)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edge[::2], edge[1::2] - edge[::2]


def word_hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes, none of them 0, of the words of ``raw``, behind whose last one come eight bytes."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out = mixed(mixed(size.astype(np.uint64)) ^ (eight[begin] & LOW.take(np.minimum(size, 8))))
    some, long = np.flatnonzero((size > 8) & (size <= LONG)), np.flatnonzero(size > LONG)
    at, left = begin[some] + 8, size[some] - 8
    while len(some):
        out[some] = mixed(out[some] + (eight[at] & LOW.take(np.minimum(left, 8))))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : begin[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    out[out == 0] = 1
    return out


class Numbers:
    """Numbers of hashes in the order in which they were added, by open addressing: 24 to 48 bytes a hash."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.hashes, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = self._first(h)
        here = self.hashes.take(at)
        out = np.where(here == h, self.numbers.take(at), -1).astype(np.int64)
        rest = np.flatnonzero((here != h) & (here != 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.hashes) - 1)
            here, want = self.hashes.take(at), h.take(rest)
            hit = here == want
            out[rest[hit]] = self.numbers.take(at[hit])
            more = ~hit & (here != 0)
            rest, at = rest[more], at[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Hashes that differ from one another and from all that are there."""
        if 2 * (self.size + len(h)) > len(self.hashes):
            held, numbers = self.hashes, self.numbers
            self.bits = max(self.bits + 1, int(2 * (self.size + len(h))).bit_length())
            self.hashes, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(held[held != 0], numbers[held != 0])
        self._put(h, np.arange(self.size, self.size + len(h), dtype=np.int32))
        self.size += len(h)

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        at = self._first(h)
        while len(h):
            free = self.hashes.take(at) == 0
            self.hashes[at[free]] = h[free]  # of several, one stays
            won = self.hashes.take(at) == h
            self.numbers[at[won]] = numbers[won]
            h, numbers, at = h[~won], numbers[~won], (at[~won] + 1) & (len(self.hashes) - 1)


class _Runs:
    """Ids of entries, numbered in the order in which they were first asked for, one run after the other."""

    def __init__(self):
        self.number: defaultdict = defaultdict(count().__next__)
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Runs of the entries numbered next."""
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these entries in a row, where each one's begin and where the last one's end)"""
        size = self.start[at + 1] - self.start[at]
        stop = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - stop + size, size) + np.arange(stop[-1] if len(at) else 0)], np.r_[0, stop]


#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 20


def in_batches(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of about so many characters, or of one longer text."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids. Keeps the ids of about ``4 * most`` words (by 64-bit hashes, some 50 MB) and ``most``
    parts of words (some 50 MB), as a worker outlives its task and stays beside those of later stages."""

    def __init__(self, path: str = WORD_BPE, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer.normalize_str
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)  # of parts with white space between them
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part
        self.last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.words, self.parts, self.most = Numbers(), _Runs(), _Runs(), most
        sample = [b"Don't-\xc3\x89a9", b"b."]
        self.apart = np.array_equal(self._together(sample)[0], np.concatenate([self._whole(w) for w in sample]))

    def _whole(self, word: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _learn_parts(self, new: list[str]) -> None:
        found, sizes = [], []
        for k in range(0, len(new), 4096):
            text = " ".join(new[k : k + 4096])
            text = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(LETTERS)
            some = text.split(" ")
            short = [" ".join(some[j : j + 256]) for j in range(0, len(some), 256)]  # takes less time than one long text
            ids = np.array([i for x in self.model.encode_batch_fast(short, add_special_tokens=False) for i in x.ids], np.uint32)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) != len(some) or stop[-1] != len(ids):
                each = [x.ids for x in self.model.encode_batch_fast(some, add_special_tokens=False)]
                ids, stop = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            found.append(ids)
            sizes.append(np.diff(stop, prepend=0))
        self.parts.add(np.concatenate(found), np.concatenate(sizes))

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words in a row, the number of each one's); the words hold no control characters. A mark stands between words, as a part of its own without ids."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = b" ".join(words).decode("utf-8", "replace")
        plain = text.isascii() or not BEYOND_LATIN(text) and "\xa0" not in text
        if plain:
            text = text.lower()
            split = pieces_ascii(text) if text.isascii() else pieces_latin(text)
        else:
            split = pieces(self.normal(f" {MARK} ".encode().join(words).decode("utf-8", "replace")))
        known = len(self.parts.number)
        at = np.fromiter(map(self.parts.number.__getitem__, split), np.int64, len(split))
        if len(self.parts.number) > known:
            self._learn_parts(list(islice(self.parts.number, known, None)))
        if plain:  # the parts of a word, one after the other, are the word
            ids, start = self.parts.of(at)
            stop = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
            word = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(words)))
            return ids, np.diff(start[np.r_[0, np.searchsorted(stop, word) + 1]])
        marks = np.flatnonzero(at == self.parts.number[MARK]) if len(words) > 1 else np.zeros(0, np.int64)
        ids, start = self.parts.of(np.delete(at, marks))
        return ids, np.diff(start[np.r_[0, marks - np.arange(len(marks)), len(at) - len(marks)]])

    def _learn(self, new: list[bytes]) -> None:
        """Ids of the words numbered next. Words with special tokens or control characters go through the whole tokenizer, each on its own."""
        joined = b" ".join(new)
        odd = not self.apart or CONTROL(joined) or b"<|" in joined
        kind = np.where(np.fromiter(map(bytes.isascii, new), bool, len(new)), 0, 1).astype(np.int8)
        if not joined.isascii() and (BEYOND_LATIN(text := joined.decode("utf-8", "replace")) or "\xa0" in text):
            kind[[not w.isascii() and (BEYOND_LATIN(x := w.decode("utf-8", "replace")) is not None or "\xa0" in x) for w in new]] = 2
        if odd:
            kind[[not self.apart or CONTROL(w) is not None or any(s in w for s in self.special) for w in new]] = 3
        order = np.argsort(kind, kind="stable")
        words = list(map(new.__getitem__, order.tolist()))
        cut, others, wholes = np.searchsorted(kind[order], [1, 2, 3]).tolist()
        whole = [self._whole(w) for w in words[wholes:]]
        found = [self._together(words[:cut]), self._together(words[cut:others]), self._together(words[others:wholes]), (np.concatenate([*whole, np.zeros(0, np.uint32)]), np.array([len(x) for x in whole], np.int64))]
        runs = _Runs()
        for ids, sizes in found:
            runs.add(ids, sizes)
        ids, start = runs.of(np.argsort(order, kind="stable"))
        self.words.add(ids, np.diff(start))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.known.size > 4 * self.most:
            self.known, self.words = Numbers(), _Runs()
        if len(self.parts.number) > self.most:
            self.parts = _Runs()
        each = [text.encode("utf-8", "surrogatepass") if text else b"" for text in texts]
        joined = b" ".join([b"", *each, b" " * 8])
        raw, ends = np.frombuffer(joined, np.uint8), np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) + 1)
        begin, size = words_of(raw)
        h = word_hashes(raw, begin, size)
        at = self.known.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            some, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at[new] = self.known.size + back
            first = new[first]
            self._learn([joined[x : x + n] for x, n in zip(begin[first].tolist(), size[first].tolist(), strict=True)])
            self.known.add(some)
        ids, start = self.words.of(at)
        raw, stop = ids.tobytes(), (4 * start[np.r_[0, np.searchsorted(begin, ends)]]).tolist()
        return [raw[x:y] for x, y in zip(stop, stop[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = WORD_BPE) -> Encoder:
    """The encoder of this process: a task finds the words that earlier tasks of the same worker met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
