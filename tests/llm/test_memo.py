"""The memo's ids equal the library's wherever white space meets white space."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from policyspark.llm import memo, queries

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BITS = ["a", "the", "it's", " ", "  ", "   ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "12", "!?", "été", "中", "é", "<|endoftext|>"]


@pytest.mark.parametrize("name", NAMES)
def test_white_space(name):
    enc = memo.MemoEncoder(queries.vocabulary(name))

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
    def same(text):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.lib.encode(text, add_special_tokens=False).ids

    same()


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(memo, "MEMO_CHARS", 10)
    enc = memo.MemoEncoder(queries.vocabulary(NAMES[0]))
    texts = ["some words here and there", "words again here", "", " x"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_are_asked_once(monkeypatch):
    asked = []
    enc = memo.MemoEncoder(queries.vocabulary(NAMES[0]))
    real = enc._library_words
    monkeypatch.setattr(enc, "_library_words", lambda words: asked.extend(words) or real(words))
    texts = ["lorem ipsum, ipsum. (ipsum", "ipsum! lorem, x", "ipsum? lorem,"]
    assert [np.frombuffer(enc.encode([t])[0], "<u4").tolist() for t in texts] == [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count(" ipsum") == 1 and len(asked) == len(set(asked))


@pytest.mark.parametrize("name", NAMES)
def test_memo_is_bounded_and_keeps_what_recurs(name, monkeypatch):
    monkeypatch.setattr(memo, "MEMO", 60)
    enc = memo.MemoEncoder(queries.vocabulary(name))
    asked = []
    real = enc._library_words
    monkeypatch.setattr(enc, "_library_words", lambda words: asked.extend(words) or real(words))
    for i in range(40):
        text = "always here, " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + i // 26)}" for k in range(10))
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.lib.encode(text, add_special_tokens=False).ids
        assert sum(map(len, (enc.memo, enc.after_blank, enc.old, enc.old_after))) <= 2 * (60 + 16)
    assert sum(w.strip() == "here" for w in asked) == 1


@pytest.mark.parametrize("name", NAMES)
def test_only_distinct_words_are_looked_up(name):
    """However often words repeat, and whatever stands next to them, a call asks the memo once for each."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    enc = memo.MemoEncoder(queries.vocabulary(name))
    enc.memo, enc.after_blank = Counted(), Counted()
    texts = ["the cat, the dog. The\ncat's dog!", "dog cat the, dog"] * 400
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
    assert Counted.asked < 100


@pytest.mark.parametrize("name", NAMES)
def test_texts_cut_together(name):
    """Ends of texts, contractions, marks and all widths of characters, many texts in one call."""
    enc = memo.MemoEncoder(queries.vocabulary(name))
    bits = [*BITS, "'", "'s", "'re", "'v", "'LL", "'ll", "s", "²", "Ⅷ", "é", "é", "𝔸", "😀", "‍", "ß", "İ"]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(bits), max_size=8).map("".join), max_size=6))
    def same(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]

    same()


def test_room_of_an_encoder(monkeypatch):
    """A larger memo gives the same ids, and keeps what a smaller one has to ask for again; encoders of both sizes live side by side."""
    monkeypatch.setattr(memo, "MEMO", 40)
    monkeypatch.setattr(memo, "LEARN", 50)
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}  x\xa0y\x85z's ß" for i in range(100)] * 2
    small, large = (memo.encoder(queries.vocabulary(NAMES[0]), room) for room in (1, 50))
    asked = []
    monkeypatch.setattr(memo.MemoEncoder, "_library_words", lambda self, words, own=memo.MemoEncoder._library_words: asked.extend([self.room] * len(words)) or own(self, words))
    assert small.encode(texts) == large.encode(texts) == small._library(texts)
    assert 0 < asked.count(50) < asked.count(1) and small is memo.encoder(queries.vocabulary(NAMES[0]))


@pytest.mark.parametrize("name", NAMES)
def test_known_words_are_found_without_python(name):
    """Texts of short words that are known ask the memo's dictionary for none of them."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    enc = memo.MemoEncoder(queries.vocabulary(name))
    texts = ["the cat, the dog. The\ncat's dog!", "été 12 fifteenletters", ""]
    want = [enc.encode(texts), enc.encode(texts)]
    enc.memo, enc.old = Counted(enc.memo), Counted(enc.old)
    assert enc.encode(texts) == want[0] == want[1] == enc._library(texts) and Counted.asked == 0
    texts = ["antidisestablishmentarianism"] * 3
    assert enc.encode(texts) == enc._library(texts) and 0 < Counted.asked <= 2 and len(enc.memo) == 1


@pytest.mark.parametrize("same_slot", [False, True])
def test_words_keep_apart(same_slot, monkeypatch):
    """Words of all lengths, with NULs at their ends, whose bytes begin alike, also where all meet at one slot."""
    if same_slot:
        monkeypatch.setattr(memo.Known, "_slot", lambda self, low, high: np.full(len(low), len(self.number) - 2))
    enc = memo.MemoEncoder(queries.vocabulary(NAMES[0]))
    words = [c * n + e for n in range(18) for c in "aé中" for e in ("", "b", "bc")] + ["\0" * n for n in range(1, 18)] + ["!" + "\0" * n for n in range(17)] + ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(300)]
    for texts in (words, [" ".join(words)], words[::-1]):
        assert enc.encode(texts) == enc._library(texts)


def test_tables_grow_and_are_bounded(monkeypatch):
    monkeypatch.setattr(memo, "MEMO", 5000)
    enc = memo.MemoEncoder(queries.vocabulary(NAMES[0]))
    for i in range(10):
        texts = [" ".join(f"w{chr(97 + i)}{k:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(j, j + 100)) for j in range(0, 3000, 100)]
        assert enc.encode(texts) == enc._library(texts)
        assert max(enc.known.n, enc.known_old.n) <= 5000 + 3200
        assert 2 * enc.known.keyed <= len(enc.known.number)
    assert enc.known_old.n > 5000
