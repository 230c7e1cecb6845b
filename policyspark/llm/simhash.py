"""SimHash near-deduplication over vantage-point trees.

1. A Python stage turns each text into a 64-bit fingerprint; equal fingerprints
   become one class before any comparison.
2. A bounded sample of fingerprints gives the upper levels of a vantage-point
   tree: inner nodes with a point and a median distance, leaves that are shards.
   Each fingerprint goes to its home leaf, and as a query to every later leaf
   that the triangle inequality can't rule out within ``bits``. Beyond
   ``TOP_LEVELS`` each leaf gets a tree of its own, grown in a task from the
   leaf's sample and joined to the leaf's rows, so neither the driver's sample
   nor a shard grows with the data.
3. Each shard builds a tree of its own over its residents, answers its queries
   exactly and joins what it finds by union-find, so that it hands on at most
   one link a row, never all pairs of a group.
4. Links meet in alternating star contraction, which takes a logarithmic number
   of rounds, each written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.llm import resemblance
from policyspark.llm.bpe import slices
from policyspark.llm.common import bound_batches, contract, discard, lean, materialize, shuffle_partitions

#: Distinct fingerprints of a shard, on average, and its local tree's leaves.
SHARD, LEAF = 8192, 128
#: Sampled fingerprints for each shard, and the levels that the driver grows.
SAMPLE_PER_SHARD, TOP_LEVELS = 48, 12
_STEP = 1 << 17


def _bit_counts(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    counts, total = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    for a in range(0, total, _STEP):
        part = words[a : min(total, a + _STEP) + size - 1]
        shingles = zip(*(part[k:] for k in range(size))) if len(words) >= size else [tuple(words)]
        raw = b"".join([digest(b" ".join(s), 42) for s in shingles])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts, total


def simhash_texts(texts: list[str | None], size: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints: bit set where over half the shingles' XXH64 have it."""
    digest, join = xxhash.xxh64_digest, b" ".join
    ones, totals = np.zeros((len(texts), 64), np.int64), np.ones(len(texts), np.int64)
    raw, owners, lens, held = [], [], [], 0

    def flush():
        if owners:
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 8), axis=1)
            ones[owners] = np.add.reduceat(bits, np.cumsum([0, *lens[:-1]]), axis=0, dtype=np.int32)
            totals[owners] = lens
        raw.clear(), owners.clear(), lens.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        if len(words) > _STEP:
            ones[i], totals[i] = _bit_counts(words, size)
            continue
        shingles = list(zip(*(words[k:] for k in range(size)))) if len(words) >= size else [tuple(words)]
        raw += [digest(join(s), 42) for s in shingles]
        owners.append(i)
        lens.append(len(shingles))
        held += len(shingles)
        if held >= _STEP:
            flush()
            held = 0
    flush()
    return np.packbits(2 * ones > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and the fingerprint ``fp`` (long) of every row; no words: zero."""
    bound_batches(docs.sparkSession)

    def stage(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(simhash_texts(texts[a:b], size))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(stage), "doc_id long, fp long")


def _apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(points: np.ndarray, levels: int) -> list[tuple[int, int]]:
    """Upper tree as a heap of (vantage point, radius), from a sample.

    Of a few candidates the one with the widest spread of distances becomes the
    vantage point. Node k has the children 2k+1 (within the radius) and 2k+2.
    """
    heap: list[tuple[int, int]] = []
    level, rng = [points], np.random.default_rng(42)
    for _ in range(levels):
        below = []
        for pts in level:
            if not len(pts):
                heap.append((0, 0))
                below += [pts, pts]
                continue
            tries = pts[rng.integers(0, len(pts), 8)]
            vantage = max(tries, key=lambda p: _apart(pts, p).std())
            d = _apart(pts, vantage)
            radius = int(np.median(d))
            heap.append((int(vantage), radius))
            below += [pts[d <= radius], pts[d > radius]]
        level = below
    return heap


def assign(fps: np.ndarray, heap: list[tuple[int, int]], bits: int, resident: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, index of fingerprint and 0 (resident) or 1 (query) of each entry.

    Rows that aren't ``resident`` only ask, at every leaf within reach.
    """
    leaves: list[tuple[int, np.ndarray, np.ndarray]] = []
    todo, inner = [(0, np.arange(len(fps)), np.ones(len(fps), bool) if resident is None else resident)], len(heap)
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node >= inner:
            leaves.append((node - inner, rows, home))
            continue
        vantage, radius = heap[node]
        d = _apart(fps[rows], np.uint64(vantage)).astype(np.int64)
        near, far = d <= radius + bits, d > radius - bits
        todo.append((2 * node + 1, rows[near], home[near] & (d[near] <= radius)))
        todo.append((2 * node + 2, rows[far], home[far] & (d[far] > radius)))
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    leaf = np.concatenate([np.full(len(r), k) for k, r, _ in leaves])
    rows, home = np.concatenate([r for _, r, _ in leaves]), np.concatenate([h for _, _, h in leaves])
    own = np.full(len(fps), -1, np.int64)
    own[rows[home]] = leaf[home]
    keep = home | (leaf > own[rows])  # a pair's earlier resident asks at the later one's leaf
    return leaf[keep], rows[keep], (~home[keep]).astype(np.int64)


class Tree:
    """A shard's vantage-point tree over its residents."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.root = self._build(np.arange(len(fps)), 0)

    def _build(self, rows: np.ndarray, depth: int):
        if len(rows) <= LEAF or depth >= 24:
            return rows
        pts = self.fps[rows]
        vantage = max(pts[:: max(1, len(pts) // 5)][:5], key=lambda p: _apart(pts, p).std())
        d = _apart(pts, vantage)
        radius = int(np.median(d))
        near = d <= radius
        if near.all() or not near.any():
            return rows
        return vantage, radius, self._build(rows[near], depth + 1), self._build(rows[~near], depth + 1)

    def pairs(self, queries: np.ndarray, bits: int):
        """Batches of (query row, resident row) within ``bits``."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, tuple):
                vantage, radius, near, far = node
                d = _apart(queries[rows], vantage).astype(np.int64)
                todo.append((near, rows[d <= radius + bits]))
                todo.append((far, rows[d > radius - bits]))
                continue
            for a in range(0, len(rows), 4096):
                some = rows[a : a + 4096]
                for b in range(0, len(node), 1024):
                    q, r = np.nonzero(_apart(queries[some][:, None], self.fps[node[b : b + 1024]][None, :]) <= bits)
                    if len(q):
                        yield some[q], node[b : b + 1024][r]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def shard_links(residents: np.ndarray, queries: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """At most one link for each fingerprint, joining all that are within ``bits``."""
    if not len(residents):
        return []
    every = np.concatenate([residents, queries])
    parent = np.arange(len(every))
    tree = Tree(residents)
    for q, r in tree.pairs(every, bits):
        a, b = parent[q], parent[r]
        while True:  # labels of many rows at once; most pairs of a group are joined already
            up, down = parent[a], parent[b]
            if (up == a).all() and (down == b).all():
                break
            a, b = up, down
        open_ = a != b
        if open_.any():
            for x, y in np.unique(np.stack([np.minimum(a, b)[open_], np.maximum(a, b)[open_]], axis=1), axis=0).tolist():
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    roots = np.array([_find(parent, i) for i in np.flatnonzero(parent != np.arange(len(every))).tolist()], np.int64)
    linked = np.flatnonzero(parent != np.arange(len(every)))
    return list(zip(every[linked].view(np.int64).tolist(), every[roots].view(np.int64).tolist()))


def _entries(leaf: np.ndarray, role: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(role, pa.int64()), pa.array(fps.view(np.int64))], ["leaf", "role", "fp"])


def _deeper(dealt: DataFrame, levels: int, bits: int) -> DataFrame:
    """Entries of leaves dealt on by a tree of each leaf's own, of ``levels`` levels."""
    dealt = materialize(dealt, "leaves")
    some = dealt.where((F.col("role") == 0) & (F.pmod(F.xxhash64("fp"), F.lit(max(1, SHARD // SAMPLE_PER_SHARD))) == 0))

    def tree(frame):
        heap = grow(np.sort(frame["fp"].to_numpy()).view(np.uint64), levels)
        raw = np.array([v for v, _ in heap], "<u8").tobytes() + np.array([r for _, r in heap], "<u8").tobytes()
        return pd.DataFrame({"leaf": [int(frame["leaf"].iloc[0])], "tree": [raw]})

    trees = materialize(some.groupBy("leaf").applyInPandas(tree, "leaf long, tree binary"), "trees")

    # a leaf's tree is a row that comes before the leaf's own rows
    rows = dealt.select("leaf", F.lit(1).alias("turn"), "role", "fp", F.lit(None).cast("binary").alias("tree"))
    rows = rows.unionByName(trees.select("leaf", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("role"), F.lit(0).cast("long").alias("fp"), "tree"))

    def deal(batches):
        now, heap = None, [(0, 0)] * ((1 << levels) - 1)
        for batch in batches:
            leaf, turn, role, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if leaf[a] != now:
                    now, heap = leaf[a], [(0, 0)] * ((1 << levels) - 1)
                if turn[a] == 0:
                    heap = [(int(v), int(r)) for v, r in np.frombuffer(batch.column(4)[a].as_py(), "<u8").reshape(2, -1).T]
                    a += 1
                for k in range(a, b, 512):
                    part = fps[k : min(b, k + 512)].view(np.uint64)
                    below, where, asks = assign(part, heap, bits, role[k : min(b, k + 512)] == 0)
                    yield _entries((int(now) << levels) + below, asks, part[where])

    parts = shuffle_partitions(dealt.sparkSession)
    return rows.repartition(parts, "leaf").sortWithinPartitions("leaf", "turn").mapInArrow(lean(deal), "leaf long, role long, fp long")


def links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints ``fp`` within ``bits``."""
    spark = classes.sparkSession
    n = classes.count()
    levels = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    top = min(TOP_LEVELS, levels)
    bound = SAMPLE_PER_SHARD << top  # a bounded sample of fingerprints, for vantage points only
    sample = [r[0] for r in classes.orderBy(F.xxhash64("fp")).limit(bound).collect()] if top else []
    heap = grow(np.array(sample, np.int64).view(np.uint64), top)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fps), 512):
                leaf, rows, role = assign(fps[a : a + 512], heap, bits)
                yield _entries(leaf, role, fps[a : a + 512][rows])

    def search(batches):
        now, residents, queries = None, [], []

        def close():
            found = shard_links(*(np.concatenate(x).view(np.uint64) if x else np.zeros(0, np.uint64) for x in (residents, queries)), bits)
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            leaf, role, fp = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if leaf[a] != now:
                    yield from close()
                    now, residents, queries = leaf[a], [], []
                residents.append(fp[a:b][role[a:b] == 0])
                queries.append(fp[a:b][role[a:b] == 1])
        yield from close()

    dealt = classes.select("fp").mapInArrow(lean(deal), "leaf long, role long, fp long")
    if levels > top:
        dealt = _deeper(dealt, levels - top, bits)
    parts = max(1 << levels, shuffle_partitions(spark))
    return dealt.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(lean(search), "u long, v long")


def simhash_components(docs: DataFrame, bits: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row.

    Null and empty texts, and texts of white space, have fingerprint zero and
    link like any other; texts of fewer than ``size`` words are one shingle.
    Repeated rows share their class. An empty table gives an empty result.
    Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, size), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = contract(links(classes.select("fp"), bits))
    placed = classes.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    members = placed.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def drop_near_copies(docs: DataFrame, bits: int = 3, size: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Fingerprints within ``bits`` and keys of bands propose; only texts whose sets
    of ``words``-word shingles have at least ``similarity`` are linked. Null
    and empty texts and texts of white space are copies of one another; texts of
    fewer words than a shingle are copies if all their words are equal. Rows
    without doc_id stay; rows that repeat a doc_id stay or go together. Other
    columns come along unchanged; an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, size).where("doc_id is not null"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.count("*").alias("n"))
    near = materialize(links(classes.select("fp"), bits), "near")
    # any two fingerprints within reach met in a shard, where both have the same root
    keys = near.select(F.col("u").alias("fp"), "v").union(near.select(F.col("v").alias("fp"), "v")).union(classes.where("n > 1").select("fp", F.col("fp").alias("v"))).distinct()
    groups = materialize(prints.join(keys, "fp").select("doc_id", F.xxhash64("v", F.lit("fingerprint")).alias("key")).distinct(), "groups")
    discard(prints, near)
    found = resemblance.similar_pairs(docs, words, similarity, groups)
    copies = contract(found).select(F.col("u").alias("_copy")).distinct()
    discard(groups)
    return docs.join(copies, docs["doc_id"].cast("long") == F.col("_copy"), "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
