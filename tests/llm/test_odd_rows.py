"""Odd rows of chats and packing: clashing columns, very long texts, repeated and null ids."""

import hashlib
from collections import defaultdict

import numpy as np

from policyspark.llm import chat, packing, queries


def test_chats_of_odd_rows(spark):
    """A very long turn, control strings, null texts and columns that clash with internal ones; each conversation reads back."""
    long = "word <|im_end|> " * 60_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long + "x"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "\\<|im_start|>\n")]
    rows = spark.createDataFrame([(*t, "s", 7) for t in turns], "conv_id long, turn int, role string, text string, said string, seq int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chat.events_of(rows.select("conv_id", "turn", "role", "text")))).collect()}
    for conv in (1, 2, 3):
        own = [(r, t or "") for c, _, r, t in turns if c == conv]
        assert got[conv]["n_turns"] == len(own)
        assert hashlib.sha256(got[conv]["said"].encode()).hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss"] == "".join(t for r, t in own if r == "assistant")


def test_packing_of_odd_rows(spark):
    """Pieces of repeated and null ids, null, empty and long texts are those of the documents' own ids, each once."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    texts = [(1, None), (2, ""), (2, "a b c"), (2, "a b c"), (None, "x y"), (None, None), (3, "some words " * 9000), (4, "same " * 300)]
    table = spark.createDataFrame([(k, t, "z", "z") for k, t in texts], "doc_id long, text string, ids string, start string")
    pieces = packing.pack_documents(table, queries.vocabulary("byte_bpe_50k.json")).collect()
    want = defaultdict(int)
    for k, t in texts:
        want[k] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    have = defaultdict(int)
    for p in pieces:
        have[p["doc_id"]] += p["length"]
        assert len(p["ids"]) == 4 * p["length"] and p["start"] + p["length"] <= p["doc_tokens"]
    assert have == want
    long = sorted((p for p in pieces if p["doc_id"] == 3), key=lambda p: p["start"])
    ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in long), "<u4").tolist()
    assert ids == lib.encode("some words " * 9000, add_special_tokens=False).ids + [1]
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert packing.pack_documents(table.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0
