"""Lexical retrieval packing: windows filled with a seed's BM25 neighbours.

The stream of documents that a task reads is cut into shards of about
``SHARD`` ids. A shard has its own BM25 inverted index over its documents'
ids. A window begins with a seed document; unused neighbours follow by falling
score until it is full, and what the window cuts off the last one is the next
seed, so every window but a shard's last has exactly ``window`` ids. That last
one is cut into lengths that are powers of two, which need no padding.

Nothing is shuffled: a document's neighbours are sought in its own shard.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from policyspark.llm import memo
from policyspark.llm.bpe import slices
from policyspark.llm.common import OUT_BYTES, bound_batches, lean

SHARD = 1 << 20
K1, B = 1.2, 0.75
#: A term of more than one in so many of a shard's documents has a row of weights.
DENSE = 8
#: Documents of a shard up to which all their scores are computed at once, and pairs of documents of rare terms that one pass adds up.
WHOLE, PAIRS = 1448, 1 << 18
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class InvertedIndex:
    """BM25 postings of a shard; a posting's weight is computed once."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs, self.n = docs, len(docs)
        lens = np.array([len(d) for d in docs], np.int64)
        key = np.concatenate(docs).astype(np.uint64)
        key <<= np.uint64(32)
        key |= np.repeat(np.arange(self.n, dtype=np.uint32), lens)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(first, append=len(key))
        key = key[first]
        self.doc = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key >>= np.uint64(32)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.terms, self.first = key[first], np.append(first, len(key))
        df = np.diff(self.first)
        norm = K1 * (1 - B + B * lens / max(1.0, lens.mean()))
        self.weight = tf * (K1 + 1) / (tf + norm[self.doc])
        self.weight *= np.repeat(np.log1p((self.n - df + 0.5) / (df + 0.5)), df)
        # terms of many documents as whole rows of weights, which add up faster than postings; at most as many numbers as 8 times their postings
        common = np.flatnonzero(df * DENSE > self.n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        of = np.repeat(self.row, df)
        own = of >= 0
        self.rows[of[own], self.doc[own]] = self.weight[own]

    @cached_property
    def every(self) -> np.ndarray:
        """Scores of all documents for each as a seed; a term of one document counts for no other."""
        found = ((self.rows > 0).T.astype(np.float32) @ self.rows).astype(np.float64)
        df = np.diff(self.first)
        rare = np.flatnonzero((self.row < 0) & (df > 1))
        squares = np.cumsum(df[rare] ** 2)
        for some in np.split(rare, np.flatnonzero(np.diff(squares // PAIRS)) + 1):
            size = df[some]
            post = np.repeat(self.first[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            size = np.repeat(size, size)  # each posting meets its term's postings
            other = np.repeat(np.repeat(self.first[some], df[some]) - np.cumsum(size) + size, size) + np.arange(size.sum())
            found += np.bincount(np.repeat(self.doc[post], size) * self.n + self.doc[other], self.weight[other], self.n**2).reshape(found.shape)
        return found

    def scores(self, seed: int) -> np.ndarray:
        if self.n <= WHOLE:
            return self.every[seed].copy()
        terms = np.searchsorted(self.terms, np.unique(self.docs[seed]).astype(np.uint64))
        row = self.row[terms]
        rare = terms[row < 0]
        lists = [slice(a, b) for a, b in zip(self.first[rare].tolist(), self.first[rare + 1].tolist())]
        found = self.rows[row[row >= 0]].sum(axis=0)
        return found + np.bincount(np.concatenate([self.doc[p] for p in lists]), np.concatenate([self.weight[p] for p in lists]), self.n) if lists else found


def pack_shard(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces; each id lies in one piece."""
    index, used = InvertedIndex(docs), np.zeros(len(docs), bool)
    windows, now, room, seed, at, unseen = [], [], window, -1, 0, 0
    while True:
        if seed < 0:
            while unseen < len(docs) and used[unseen]:
                unseen += 1
            if unseen == len(docs):
                break
            seed, at = unseen, 0
            used[seed] = True
        ranked, r, current = None, 0, seed
        while current >= 0:
            take = min(room, len(docs[current]) - at)
            now.append((current, at, take))
            room, at = room - take, at + take
            if room == 0:
                windows.append(now)
                now, room = [], window
                if at < len(docs[current]):
                    if current != seed or ranked is not None:
                        break
                    continue
                current, at = -1, 0
                break
            if ranked is None:
                score = index.scores(seed)
                score[used] = -1
                # at least as many as could fill the window; the rest is sorted only when these run out
                ranked = np.flatnonzero(score > 0)
                ranked = ranked[np.argsort(-score[ranked], kind="stable")]
            current, at = -1, 0
            while r < len(ranked) and current < 0:
                if not used[ranked[r]]:
                    current = int(ranked[r])
                    used[current] = True
                r += 1
        seed = current
    if now:
        windows.append(now)
    return windows


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short window's pieces as windows whose lengths are powers of two, longest first."""
    out, todo, left = [], list(pieces), sum(p[2] for p in pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        now = []
        while room:
            d, at, n = todo.pop(0)
            take = min(n, room)
            now.append((d, at, take))
            room -= take
            if take < n:
                todo.insert(0, (d, at + take, n - take))
        out.append(now)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed once
    each; an empty table gives no pieces. Texts of any length are cut at window
    ends only. ``ids`` are the piece's ids, little-endian unsigned 32-bit.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def stage(batches):
        enc, sequence = memo.encoder(tokenizer), TaskContext.get().partitionId() << 40
        keys, held, total = [], [], 0

        def emit():
            nonlocal sequence
            windows = pack_shard(held, window) if held else []
            short = sum(p[2] for p in windows[-1]) < window if windows else False
            windows = windows[:-1] + powers_of_two(windows[-1]) if short else windows
            rows = [[] for _ in names]
            for pieces in windows:
                offset = 0
                for d, at, n in pieces:
                    for column, value in zip(rows, (keys[d], at, n, held[d][at : at + n].tobytes(), len(held[d]), sequence, offset)):
                        column.append(value)
                    offset += n
                sequence += 1
            for a in range(0, len(rows[0]), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 2000], pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, rows)], names)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = batch.column(0).to_pylist()
            for a, b in slices(texts, OUT_BYTES // 4):
                for key, ids in zip(own[a:b], enc.encode([t or "" for t in texts[a:b]])):
                    keys.append(key)
                    held.append(np.frombuffer(ids + end, "<u4"))
                    total += len(held[-1])
                    if total >= SHARD:
                        yield from emit()
                        keys, held, total = [], [], 0
        yield from emit()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(stage, memo.ENCODERS), PIECES)
