"""Token ids by the tokenizers library, asked once per distinct word.

Words repeat, and the library takes some microseconds a word, so the ids of
each distinct word are kept in a bounded memo. Many texts are cut at once, by
the classes of their code points, where the tokenizer's own pattern cuts. Words
of up to 15 bytes, nearly all, are looked up in numpy arrays, by all of their
bytes; Arrow finds the distinct ones of the rest, and numpy puts the ids
together, so that Python looks at new and long words only, once for each.
"""

from __future__ import annotations

import json
import os
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex

from policyspark.llm.common import WHITE, cache_of_worker

#: Words, and their characters, that a worker's memo takes before it becomes the old one, which is asked before the library.
MEMO, MEMO_CHARS = 250_000, 1 << 23
#: Characters of texts that are cut at once.
LEARN = 1 << 19
#: The pattern of lower-casing tokenizers that are known here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WHITE, _LETTER, _NUMBER, _OTHER = range(4)
#: The name of the encoders among what a worker keeps.
ENCODERS = "encoders"
_workers: dict[tuple[str, int], "MemoEncoder"] = cache_of_worker(ENCODERS)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Code points of bytes as letters; 255, which UTF-8 never has, parts words.
_LETTERS = np.array([ord(c) for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])], "<u4")
_LETTERS[255] = ord("\n")


@cache
def kinds() -> np.ndarray:
    """White space, letter, number or other of every code point."""
    every, found = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_WHITE, f"[{WHITE}]+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return found


def _contractions(code: np.ndarray, kind: np.ndarray, first: np.ndarray, new: np.ndarray) -> None:
    """Cuts 's, 't, 're, 've, 'm, 'll and 'd where a word begins with an apostrophe."""
    at = np.flatnonzero(code[:-1] == 39)
    at = at[new[at] & (kind[at + 1] == _LETTER) & ~first[at + 1]]
    a, after = code[at + 1], np.minimum(at + 2, len(code) - 1)
    b = np.where((at + 2 < len(code)) & ~first[after], code[after], 0)
    two = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
    for own, size in ((np.isin(a, [ord(c) for c in "stmd"]), 2), (two, 3)):
        new[at[own] + 1] = False
        ends = at[own] + size
        new[ends[ends < len(code)]] = True


def byte_words(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern begins a word; ``first`` has where texts begin."""
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    white = kind == _WHITE
    # the last white space before something else is a word, or a blank begins the next one
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
    new[last] = True
    new[last[code[last] == 32] + 1] = False
    _contractions(code, kind, first, new)
    return new


def lower_words(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the lower-casing pattern begins a word or white space."""
    new = first | (kind == _NUMBER)
    new[1:] |= kind[1:] != kind[:-1]
    _contractions(code, kind, first, new)
    return new


#: By a word's length: the bits of its first and its next eight bytes that are its own. A longer word has none.
_OWN = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] if n < 16 else [0, 0] for n in range(17)], np.uint64).T.copy()
#: By a word's length: what its key has above its bytes.
_LENGTH = np.array([n << 56 if n < 16 else 0 for n in range(17)], np.uint64)


def word_keys(raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers for each word of up to 15 bytes, which hold its bytes and its length; zeros for a longer one."""
    eight = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), strides=(1,))
    size = np.minimum(size, 16)
    low = eight[start]
    low &= _OWN[0].take(size)
    high = eight[start + 8]
    high &= _OWN[1].take(size)
    high |= _LENGTH.take(size)
    return low, high


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Known:
    """Ids of words by their number, and a hash table from the keys of :func:`word_keys` to numbers."""

    def __init__(self):
        self.n = self.keyed = 0
        # the ids of word i lie from begin[i] to begin[i + 1]
        self.begin, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)
        self._empty(1 << 12)

    def _empty(self, slots: int) -> None:
        self.low, self.high, self.number = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = low * np.uint64(0x9E3779B97F4A7C15)
        found ^= high * np.uint64(0xC2B2AE3D27D4EB4F)
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found >>= np.uint64(65 - len(self.number).bit_length())
        return found.view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key; -1: unknown, or no key."""
        at = self._slot(low, high)
        found = self.number.take(at)
        other = np.flatnonzero((self.low.take(at) != low) | (self.high.take(at) != high))
        while (other := other[found.take(other) >= 0]).size:  # the next slot, until the key or an empty one comes
            here = at[other] = at.take(other) + 1 & len(self.number) - 1
            found[other] = self.number.take(here)
            other = other[(self.low.take(here) != low.take(other)) | (self.high.take(here) != high.take(other))]
        found[high == 0] = -1
        return found

    def _put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Keys that are new and distinct; at most half of the slots are taken."""
        self.keyed += len(low)
        if 2 * self.keyed > len(self.number):
            own = np.flatnonzero(self.number >= 0)
            low, high, number = (np.concatenate([x[own], y]) for x, y in ((self.low, low), (self.high, high), (self.number, number)))
            self._empty(1 << (2 * self.keyed - 1).bit_length())
        at, todo = self._slot(low, high), np.arange(len(low))
        while todo.size:
            here, mine = at.take(todo), number.take(todo)
            free = self.number.take(here) < 0
            self.number[here[free]] = mine[free]  # one of those that meet at a free slot gets it
            got = self.number.take(here) == mine
            self.low[here[got]], self.high[here[got]] = low[todo[got]], high[todo[got]]
            todo = todo[~got]
            at[todo] = at.take(todo) + 1 & len(self.number) - 1

    def add(self, low: np.ndarray, high: np.ndarray, found: list[bytes]) -> np.ndarray:
        """Numbers for distinct words that are new, with their ids; words without a key are the caller's to find again."""
        number = np.arange(self.n, self.n + len(found), dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")
        ends = self.begin[self.n] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self.ids = _with_room(self.ids, int(self.begin[self.n]) + len(ids))
        self.ids[self.begin[self.n] : self.begin[self.n] + len(ids)] = ids
        self.begin = _with_room(self.begin, self.n + len(found) + 1)
        self.begin[self.n + 1 : self.n + len(found) + 1] = ends
        self.n += len(found)
        keyed = high > 0
        self._put(low[keyed], high[keyed], number[keyed])
        return number

    def ids_of(self, number: np.ndarray) -> list[bytes]:
        return [self.ids[a:b].tobytes() for a, b in zip(self.begin.take(number).tolist(), self.begin.take(number + 1).tolist())]


class MemoEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Two shapes of tokenizer.json are cut into words here: byte-level ones with
    their own pattern, and lower-casing ones that drop white space. Texts with
    a special token, or (lower-casing) with characters beyond Latin-1, and all
    other tokenizers go to the library whole. ``room`` multiplies what the memo
    and a cut take.
    """

    def __init__(self, path: str, room: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.room = path, room
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "whole"
        # words of up to 15 bytes are found by the keys of these, the numbers of longer ones by the memo
        self.known, self.known_old = Known(), Known()
        self.memo, self.old, self.held = {}, {}, 0
        # words after a blank are kept with the others
        self.after_blank, self.old_after = {}, {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "byte"
        elif norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            pattern = pre["pretokenizers"][0]
            if pattern["behavior"] == "Removed" and pattern["invert"] and pattern["pattern"].get("Regex") == WORDS:
                self.kind = "word"
        # words are cut and written as letters here, so the library's model gets them as they are
        self.model = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "truncation": None, "padding": None}))
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for w, i in vocab.items():
            self.size[i] = len(w.removesuffix(suffix))

    @cached_property
    def lib(self):
        """The library's own tokenizer, for texts that go to it whole."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_padding()
        found.no_truncation()
        return found

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _library_words(self, words: list[str]) -> list[bytes]:
        """Ids of words by the library's model, all in one text; the bytes that each token stands for tell where a word ends."""
        if not words:
            return []
        raw = np.frombuffer(b"\xff".join(map(str.encode, words)) + b"\xff", np.uint8)
        ids = np.array(self.model.encode_batch_fast([_LETTERS.take(raw).tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(raw == 255)
        stops -= np.arange(len(stops))
        upto = np.cumsum(self.size[ids])
        last = np.searchsorted(upto, stops)
        if not len(ids) or upto[-1] != stops[-1] or (upto[last] != stops).any():
            return self._library(words)
        raw, stops = ids.tobytes(), (4 * (last + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def _numbers(self, words: list[str], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of distinct words, long ones or new; new ones' ids are taken over from the old memo or asked of the library."""
        found = np.full(len(words), -1, np.int32)
        for i in np.flatnonzero(high == 0).tolist():
            found[i] = self.memo.get(words[i], -1)
        new = np.flatnonzero(found < 0)
        before = self.known_old.find(low[new], high[new])
        for i in np.flatnonzero(high[new] == 0).tolist():
            before[i] = self.old.get(words[new[i]], -1)
        kept, fresh = new[before >= 0], new[before < 0]
        asked = [words[i] for i in fresh.tolist()]
        new = np.concatenate([kept, fresh])
        found[new] = self.known.add(low[new], high[new], self.known_old.ids_of(before[before >= 0]) + self._library_words(asked))
        for i in new[high[new] == 0].tolist():
            self.memo[words[i]] = int(found[i])
        self.held += sum(map(len, asked)) + sum([len(words[i]) for i in kept.tolist()])
        return found

    def _cut(self, text: str) -> str | None:
        """The text as it is cut into words here; None: the library gets it whole."""
        if any(s in text for s in self.special):
            return None
        if self.kind == "byte":
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._library(texts)
        out: list[bytes] = []
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= self.room * LEARN or i + 1 == len(texts):
                out += self._some(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        own = iter(self._words([t for t in cut if t is not None]))
        whole = iter(self._library([t for t, c in zip(texts, cut) if c is None]) if None in cut else [])
        return [next(whole if c is None else own) for c in cut]

    def _words(self, texts: list[str]) -> list[bytes]:
        if self.known.n > self.room * MEMO or self.held > self.room * MEMO_CHARS:
            self.known_old, self.known = self.known, Known()
            self.old, self.memo, self.held = self.memo, {}, 0
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        try:
            code = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begins = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(code) + 1, bool)
        first[begins] = True
        kind = kinds().take(code)
        at = np.flatnonzero((byte_words if self.kind == "byte" else lower_words)(code, kind, first[:-1]))
        raw, stops = joined.encode(), np.append(at, len(code))
        if len(raw) > len(code):  # from code points to bytes
            stops = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw)).take(stops)
        start, size = stops[:-1], np.diff(stops)
        if self.kind == "word":  # white space has no ids
            own = np.flatnonzero(kind.take(at) != _WHITE)
            at, start, size = at[own], start[own], size[own]
        low, high = word_keys(raw, start, size)
        number = self.known.find(low, high)
        if (rest := np.flatnonzero(number < 0)).size:
            bounds = np.append(0, np.cumsum(size[rest]))
            take = np.repeat(start[rest] - bounds[:-1], size[rest])
            take += np.arange(len(take))
            wide = bounds[-1] >> 31
            words = np.frombuffer(raw, np.uint8).take(take)
            words = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(rest), pa.py_buffer(bounds.astype(np.int64 if wide else np.int32)), pa.py_buffer(words)).dictionary_encode()
            which, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
            one = np.zeros(len(distinct), np.int64)
            one[which] = rest
            number[rest] = self._numbers(distinct, low[one], high[one]).take(which)
        begin = self.known.begin.take(number)
        size = self.known.begin.take(number + 1) - begin
        upto = np.append(0, np.cumsum(size))
        # each word's ids, from where all words' ids lie side by side
        take = np.repeat(begin - upto[:-1], size)
        take += np.arange(len(take))
        ids = self.known.ids.take(take).tobytes()
        bounds = (4 * upto[np.searchsorted(at, begins)]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def encoder(path: str, room: int = 1) -> MemoEncoder:
    """This Python worker's encoder; tasks that share the worker share the memo."""
    if (path, room) not in _workers:
        _workers[path, room] = MemoEncoder(path, room)
    return _workers[path, room]
