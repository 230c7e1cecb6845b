"""Near copies by the Jaccard similarity of their sets of word shingles.

SimHash at a radius that a vantage-point tree can prune reaches only nearly
identical texts, so the pipeline's near-dedup stage adds this search for what
is left at a similarity of 0.8.

1. A Python stage gives each text ``BANDS`` keys, each of ``ROWS`` min-hashes;
   texts of similarity 0.8 share a key with probability 1 - (1 - 0.8^5)^20,
   over 0.999. The low bits of all its min-hashes are the text's sketch.
2. Rows of a key are dealt into ``SALTS`` parts. A part's rows are paired with
   its lowest doc_id, and those with the key's lowest, so a group of any size
   gives one pair a row and key, and no task gets a whole hot group. Sketches,
   a fixed number of bytes each, meet first: pairs whose sketches agree in under
   ``LEAST`` of the min-hashes go no further (a pair of similarity 0.8 does so
   with a chance of about one in a million). The texts of the rest meet, and
   their exact similarity decides.
3. These links join most of a group. Of keys whose rows are still in several
   components, the rows that by their sketches may be alike to a row of another
   component are compared in full: all pairs of rows that aren't joined yet, in
   tasks of two blocks of about ``BLOCK`` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policyspark.llm.bpe import slices
from policyspark.llm.common import bound_batches, contract, discard, join_hot, lean, materialize

BANDS, ROWS = 20, 5
SALTS = 64
BLOCK = 128
#: Share of min-hashes, of 16 bits each, in which sketches must agree.
LEAST = 0.6
#: Documents whose texts are picked out by a broadcast of their ids (8 bytes each); more meet by a shuffle.
WANTED = 1 << 20
_STEP = 1 << 13
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ each[k : k + len(h)]) * _PRIME
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(shingles), _STEP):
        low = np.minimum(low, ((shingles[a : a + _STEP, None] ^ _FLIP) * _ODD).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> list[int]:
    """One key a band."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _PRIME
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def sketch(low: np.ndarray) -> bytes:
    """16 bits of each min-hash, mixed so that they don't only show how low it is."""
    return ((low * _PRIME) >> np.uint64(48)).astype("<u2").tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


def alike(x: int, y: int, common: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    """Whether sets of sizes x and y with so many common elements have at least ``similarity``; empty sets are equal."""
    return ((common > 0) | (x + y == 0)) & (common >= similarity * (x + y - common))


def hashed(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, keys and sketch of every row with a doc_id; a text without words has no keys."""
    bound_batches(docs.sparkSession)
    blank = sketch(minhashes(np.zeros(0, np.uint64)))

    def stage(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                keys, marks = [], []
                for t in texts[a:b]:
                    own = shingle_set(t, size)
                    low = minhashes(own) if len(own) else None
                    keys.append([] if low is None else band_keys(low))
                    marks.append(blank if low is None else sketch(low))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "keys", "sketch"])

    found = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null").mapInArrow(lean(stage), "doc_id long, keys array<long>, sketch binary")
    return materialize(found, "keys")


def keyed(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id and key of every row with a doc_id and words, a row for each of its bands."""
    return hashed(docs, size).select("doc_id", F.explode("keys").alias("key"))


def candidates(docs: DataFrame, size: int = 5) -> DataFrame:
    """Distinct pairs (u, v), u > v, of doc_ids that share a key, of which v is the lowest of its part or key."""
    return _stars(keyed(docs, size))


def _stars(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = materialize(rows.withColumn("v", F.min("doc_id").over(Window.partitionBy("key", "salt"))).where("doc_id > v").select("doc_id", "v").union(_tops(rows)).distinct(), "candidates")
    return parts.select(F.col("doc_id").alias("u"), "v")


def _tops(rows: DataFrame) -> DataFrame:
    tops = rows.groupBy("key", "salt").agg(F.min("doc_id").alias("doc_id"))
    return tops.withColumn("v", F.min("doc_id").over(Window.partitionBy("key"))).where("doc_id > v").select("doc_id", "v")


def _open_groups(placed: DataFrame) -> DataFrame:
    """key, rows m, largest component and its rows g, of keys with rows in several components; one key of those that hold the same rows."""
    mark = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark")
    each = placed.groupBy("key", "component").agg(F.count("*").alias("n"), mark, F.min("doc_id").alias("low"))
    whole = each.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("m"), F.sum("mark").alias("mark"), F.min("low").alias("low"), F.max(F.struct("n", "component")).alias("top")).where("c > 1")
    return whole.groupBy("m", "mark", "low").agg(F.min(F.struct("key", F.col("top.n").alias("g"), F.col("top.component").alias("largest"))).alias("k")).select("k.*", "m")


def _blocks(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """A row of doc_id, component, key, a, b, side for each task (key, a, b) that a row takes part in.

    Blocks from 0 hold the rows outside the key's largest component; each of
    them meets itself, the others, and the blocks after them, which hold the
    largest component's rows and needn't meet one another.
    """
    outer, inner = F.ceil((F.col("m") - F.col("g")) / BLOCK), F.ceil(F.col("g") / BLOCK)
    rows = join_hot(placed, groups.withColumn("size", F.col("m")), ["key"], "size").withColumns({"outer": outer, "inner": inner})
    mine = F.col("component") == F.col("largest")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.when(mine, F.col("inner")).otherwise(F.col("outer"))) + F.when(mine, F.col("outer")).otherwise(0))
    last = F.when(mine, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    other = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    return rows.select("doc_id", "component", "key", "own", other).select("doc_id", "component", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def block_links(ids: list[int], components: list[int], sets: list[np.ndarray], sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links that join all alike rows of different components: within side 0 if there is no side 1, else between both."""
    root: dict[int, int] = {c: c for c in components}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [i for i, s in enumerate(sides) if not s], [i for i, s in enumerate(sides) if s]
    alone, found = not right, []
    right = right or left
    sizes = np.array([len(sets[i]) for i in right], np.int64)
    every = np.concatenate([sets[i] for i in right]) if right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), sizes)
    for k, i in enumerate(left):
        x = sets[i]
        if alone and k == 0 or all(find(components[j]) == find(components[i]) for j in right):
            continue
        common = np.zeros(len(right), np.int64)
        if len(x):
            at = np.minimum(np.searchsorted(x, every), len(x) - 1)
            common = np.bincount(owner[x[at] == every], minlength=len(right))
        for at in np.flatnonzero(alike(len(x), sizes, common, similarity)).tolist():
            j = right[at]
            p, q = find(components[i]), find(components[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return found


def _may_link(dealt: DataFrame) -> DataFrame:
    """key and doc_id of the rows of block tasks whose sketch may be alike to one of another component."""

    def stage(batches):
        now, held, marks = None, [], []

        def close():
            if not held:
                return
            ids, comps, sides = (np.array(c) for c in zip(*held))
            each = np.frombuffer(b"".join(marks), "<u2").reshape(-1, BANDS * ROWS)
            left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
            right = right if len(right) else left
            hit = np.zeros(len(ids), bool)
            for i in left.tolist():
                near = ((each[right] == each[i]).sum(axis=1) >= LEAST * BANDS * ROWS) & (comps[right] != comps[i])
                hit[i] |= near.any()
                hit[right[near]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * int(hit.sum()), pa.int64()), pa.array(ids[hit], pa.int64())], ["key", "doc_id"])

        for batch in batches:
            names = ["key", "a", "b", "doc_id", "component", "side", "sketch"]
            for key, a, b, doc, comp, side, mark in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in names)):
                if (key, a, b) != now:
                    yield from close()
                    now, held, marks = (key, a, b), [], []
                held.append((doc, comp, side))
                marks.append(mark)
        yield from close()

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side").mapInArrow(lean(stage), "key long, doc_id long").distinct()


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id is in ``ids`` (materialised, distinct)."""
    if ids.count() <= WANTED:
        return texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts.join(ids, "doc_id", "left_semi")


def _rest(rows: DataFrame, marks: DataFrame, texts: DataFrame, roots: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links between rows that share a key and that ``roots`` doesn't join, from all their pairs."""
    placed = rows.join(roots.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").select("doc_id", "key", F.coalesce("v", "doc_id").alias("component"))
    placed = materialize(placed, "placed")
    groups = materialize(_open_groups(placed), "groups")
    near = materialize(_may_link(_blocks(placed, groups).join(marks, "doc_id")), "near")
    some = materialize(placed.join(near, ["key", "doc_id"], "left_semi"), "some")
    dealt = _blocks(some, materialize(_open_groups(some), "groups")).join(_picked(texts, materialize(some.select("doc_id").distinct(), "wanted")), "doc_id")

    def stage(batches):
        now, held = None, []
        memo: dict[str, np.ndarray] = {}

        def close():
            memo.clear()
            for _, _, _, text in held:
                if text not in memo:
                    memo[text] = shingle_set(text, size)
            found = block_links([h[0] for h in held], [h[1] for h in held], [memo[h[3]] for h in held], [h[2] for h in held], similarity)
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            names = ["key", "a", "b", "doc_id", "component", "side", "text"]
            for key, a, b, *row in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in names)):
                if (key, a, b) != now:
                    yield from close()
                    now, held = (key, a, b), []
                held.append(row)
        yield from close()

    links = materialize(dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side").mapInArrow(lean(stage), "u long, v long"), "links")
    discard(placed, groups, near, some)
    return links


def _sketched(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in at least ``LEAST`` of the min-hashes."""
    both = pairs.join(marks.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a")), "u").join(marks.select(F.col("doc_id").alias("v"), F.col("sketch").alias("b")), "v").select("u", "v", "a", "b")

    def stage(batches):
        for batch in batches:
            same = (_sketches(batch.column(2)) == _sketches(batch.column(3))).sum(axis=1) >= LEAST * BANDS * ROWS
            yield batch.select([0, 1]).filter(pa.array(same))

    return materialize(both.mapInArrow(lean(stage), "u long, v long"), "pairs")


def similar_pairs(docs: DataFrame, size: int = 5, similarity: float = 0.8, groups: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that join doc_ids whose shingle sets have at least ``similarity``.

    Texts without words and rows without doc_id have no links; equal texts do.
    Of a group, enough links to join its members are returned, not all pairs;
    every pair that shares a key is compared unless others join it already.
    ``groups`` (doc_id, key) holds further keys; by them, texts without words
    link as well.
    """
    prints = hashed(docs, size)
    marks = prints.select("doc_id", "sketch").dropDuplicates(["doc_id"])
    rows = prints.select("doc_id", F.explode("keys").alias("key"))
    if groups is not None:
        rows = materialize(rows.union(groups.select("doc_id", "key")), "rows")
    pairs = _sketched(_stars(rows), marks)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null")
    wanted = materialize(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "wanted")
    some = _picked(texts, wanted)
    both = pairs.join(some.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(some.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def stage(batches):
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            u, v, kept = batch.column(0), batch.column(1), []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, text = shingle_set(a.as_py(), size), b.as_py()
                if text not in seen:
                    seen.clear()  # one lowest document at a time
                    seen[text] = shingle_set(text, size)
                y = seen[text]
                kept.append(bool(alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), similarity)))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], ["u", "v"])

    roots = contract(both.mapInArrow(lean(stage), "u long, v long"))
    links = _rest(rows, marks, texts, roots, size, similarity)
    discard(prints, pairs, wanted, *([rows] if groups is not None else []))
    return roots if links.isEmpty() else roots.union(links)
