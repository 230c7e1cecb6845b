"""Byte-level BPE in batched numpy merge rounds, and its decoder.

The symbols of many words lie in one flat array. Each round looks all adjacent
pairs up by binary search over the sorted pair keys, takes every word's lowest
rank and merges all its occurrences at once; words without a known pair leave
the array. Distinct words are encoded once per worker and batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from policyspark.llm.common import CHUNK, OUT_BYTES, bound_batches
from policyspark.llm.memo import byte_letters

MEMO = 600_000
_NONE = np.int64(2**62)
_models: dict[str, "BytePairs"] = {}


class BytePairs:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in w) for w, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.memo: dict[str, bytes] = {}

    def merge_rounds(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            key = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.rank[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
            over = lowest == _NONE
            if over.any():
                done.append((word[over], flat[over]))
            p = np.flatnonzero((rank == lowest) & ~over)
            if len(p):
                # of a run of overlapping pairs, as in "aaa", the first, third, ... merge
                run = np.flatnonzero(np.append(True, np.diff(p) != 1))
                p = p[(np.arange(len(p)) - np.repeat(run, np.diff(np.append(run, len(p))))) % 2 == 0]
                flat[p] = self.merged[at[p]]
            keep = ~over
            keep[p + 1] = False
            flat, word = flat[keep], word[keep]
        where, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(where, kind="stable")
        counts = np.bincount(where, minlength=len(words))
        raw, ends = ids[order].astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist())]

    def _learn(self, chunks: set[str]) -> None:
        parts = {c: self.words(c) for c in chunks}
        fresh = list({p for ps in parts.values() for p in ps if p not in self.memo})
        for k in range(0, len(fresh), 50_000):
            block = fresh[k : k + 50_000]
            self.memo.update(zip(block, self.merge_rounds([w.encode() for w in block])))
        self.memo.update((c, b"".join([self.memo[p] for p in ps])) for c, ps in parts.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        plans: list[list] = []
        for t in texts:
            if self.cut and any(s in t for s in self.special):
                plans.append([self.special[x].to_bytes(4, "little") if i % 2 else CHUNK.findall(x) for i, x in enumerate(self.cut(t))])
            else:
                plans.append([CHUNK.findall(t)])
        memo = self.memo
        if new := {c for plan in plans for x in plan if isinstance(x, list) for c in x if c not in memo}:
            self._learn(new)
        get = memo.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def model(path: str) -> BytePairs:
    if path not in _models:
        _models[path] = BytePairs(path)
    return _models[path]


def slices(texts: list, size: int = OUT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``size`` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_bpe(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of each row.

    Special tokens' strings become their ids, as the tokenizers library does
    by default. Null and empty texts have no ids; repeated rows stay.
    """
    bound_batches(docs.sparkSession)

    def stage(batches):
        bpe = model(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, OUT_BYTES // 4):
                ids = bpe.encode([t or "" for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(stage, "doc_id long, n_tokens long, ids binary")


def decode_bpe(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of :func:`encode_bpe` with the decoded text; bytes that are no UTF-8 become U+FFFD."""
    bound_batches(encoded.sparkSession)

    def stage(batches):
        bpe = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [bpe.decode(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(stage, "doc_id long, n_tokens long, ids binary, text string")
