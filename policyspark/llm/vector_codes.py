"""Vector code compression: product codes whose codebooks come from member-resident Lloyd rounds.

Vectors are cut into parts. A part lives with the owner of its entry: rows are
partitioned by (position, entry, salt), where the salt deals a hot entry's members
out over many owners.

1. Each part goes to the owner of its nearest seed: the base layer, written once.
2. In a round every owner holds its resident members against the new codebook.
   Members that stay aren't written or shuffled again; only parts that change
   their entry migrate to its owner, as a new layer.
3. Whether a row of an older layer is still resident follows from the codebooks
   since its arrival: it left in the first round that found it another entry. So
   an owner needs no list of who left, and a lost executor's work can be redone
   from the layers, which are tables in the shared folder.
4. An entry's sum is that of its owners' residents: the base layer's sums, with
   what arrives added and what leaves taken away. Sums are integers, so they are exact
   however the rows are dealt.

After ``REPLAY`` layers the residents are written as one layer, so no row is held
against more codebooks than that in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.llm.common import bound_batches, discard, join_hot, materialize, shuffle_partitions
from policyspark.llm.vectors import integer_vectors, lists, matrix

#: Vectors for each salt, on average, and layers after which residents are written anew.
SALTED, REPLAY = 1 << 20, 8
_LAYER = "position int, entry int, left int, salt int, born int, part array<int>"


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry, of equally near ones the lowest, and the squared distance."""
    index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for a in range(0, len(points), 4096):
        d = ((points[a : a + 4096, None, :] - entries[None]) ** 2).sum(axis=2)
        index[a : a + 4096] = d.argmin(axis=1)
        distance[a : a + 4096] = d.min(axis=1)
    return index, distance


def _layer(position, entry, left, salt, born, part) -> pa.RecordBatch:
    ints = [pa.array(np.asarray(c), pa.int32()) for c in (position, entry, left, salt, born)]
    return pa.RecordBatch.from_arrays([*ints, lists(part, pa.int32())], ["position", "entry", "left", "salt", "born", "part"])


def _deal(vectors: DataFrame, seeds: np.ndarray, salts: int) -> DataFrame:
    """The base layer's rows: each part with its nearest seed."""
    n_parts, _, width = seeds.shape

    def stage(batches):
        for batch in batches:
            x, salt = matrix(batch.column(0), n_parts * width), batch.column(1).to_numpy()
            for p in range(n_parts):
                part = x[:, p * width : (p + 1) * width]
                entry, _ = nearest(part, seeds[p])
                yield _layer(np.full(len(x), p), entry, np.full(len(x), -1), salt, np.zeros(len(x)), part)

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return vectors.select("x", salt.alias("salt")).mapInArrow(stage, _LAYER)


def _members(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]):
    """Batches of one position and layer: (position, born, salt, entry, part, entry by the last codebook), of residents up to the one before."""
    width, last = books[0].shape[2], len(books) - 1
    for batch in batches:
        position, entry, _, salt, born = (batch.column(i).to_numpy() for i in range(5))
        part = matrix(batch.column(5), width)
        for p, b in np.unique(np.stack([position, born], axis=1), axis=0).tolist():
            rows = np.flatnonzero((position == p) & (born == b))
            for k in range(b + 1, last):
                rows = rows[nearest(part[rows], books[k][p])[0] == entry[rows]]
            if len(rows):
                yield p, b, salt[rows], entry[rows], part[rows], nearest(part[rows], books[last][p])[0]


def _movers(layers: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Residents that the last codebook gives another entry, as rows of a new layer."""

    def stage(batches):
        for p, _, salt, entry, part, now in _members(batches, books):
            go = now != entry
            if go.any():
                n = int(go.sum())
                yield _layer(np.full(n, p), now[go], entry[go], salt[go], np.full(n, len(books) - 1), part[go])

    return layers.mapInArrow(stage, _LAYER)


def _residents(layers: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """All members as they are after the last codebook's round, as one layer; none of them is written twice."""

    def stage(batches):
        for p, _, salt, entry, part, now in _members(batches, books):
            stay = now == entry
            n = int(stay.sum())
            if n:
                yield _layer(np.full(n, p), entry[stay], np.full(n, -1), salt[stay], np.full(n, len(books) - 1), part[stay])

    return layers.mapInArrow(stage, _LAYER)


def _owned(rows: DataFrame) -> DataFrame:
    return rows.repartition("position", "entry", "salt").sortWithinPartitions("position", "entry")


def _changes(layer: DataFrame, shape: tuple[int, int, int]) -> list:
    """(position, entry, coordinate, total): sums of what arrived less what left; coordinate -1 counts."""

    def stage(batches):
        n_parts, n_entries, width = shape
        total = np.zeros((n_parts, n_entries, width + 1), np.int64)
        for batch in batches:
            position, entry, left = (batch.column(i).to_numpy() for i in range(3))
            part = matrix(batch.column(5), width)
            whole = np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1)
            np.add.at(total, (position, entry), whole)
            gone = left >= 0
            np.subtract.at(total, (position[gone], left[gone]), whole[gone])
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(w, pa.int32()) for w in where), pa.array(total[where])], ["position", "entry", "coordinate", "total"])

    rows = layer.mapInArrow(stage, "position int, entry int, coordinate int, total long")
    return rows.groupBy("position", "entry", "coordinate").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def _seeds(vectors: DataFrame, n_entries: int, n_parts: int, width: int) -> np.ndarray:
    """(part, entry, component) of the lowest vec_ids; null comes last, and of an id's rows the lowest vector counts."""
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(n_entries)
    rows = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "_id")), F.col("vec_id").eqNullSafe(F.col("_id")))
    lowest = rows.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    return np.array([r["x"] for r in lowest], np.int64).reshape(-1, n_parts, width).transpose(1, 0, 2)


def fit_codebooks(vectors: DataFrame, size: int, n_parts: int = 8, n_entries: int = 16, rounds: int = 6, replay: int = REPLAY) -> np.ndarray:
    """Codebooks (part, entry, component) of integer ``vectors`` (vec_id, x) after ``rounds`` Lloyd rounds.

    Sums over all rows, each divided downwards; an entry without members stays.
    With fewer ids than entries there are only as many entries.
    """
    if size % n_parts:
        raise ValueError(f"{size} components can't be cut into {n_parts} equal parts")
    spark, width = vectors.sparkSession, size // n_parts
    bound_batches(spark)
    seeds = _seeds(vectors, n_entries, n_parts, width)
    salts = max(16, -(-shuffle_partitions(spark) // n_parts), vectors.count() // SALTED)
    total = np.zeros((*seeds.shape[:2], width + 1), object)
    books, layers = [seeds], [materialize(_owned(_deal(vectors, seeds, salts)), "layer")]
    while True:
        for r in _changes(layers[-1], seeds.shape):
            total[r["position"], r["entry"], r["coordinate"]] += int(r["total"])
        counts = total[:, :, :1]
        books.append(np.where(counts > 0, total[:, :, 1:] // np.maximum(counts, 1), books[-1]).astype(np.int64))
        if len(books) > rounds or (books[-1] == books[-2]).all():
            break
        if len(layers) > replay:
            merged = materialize(_residents(reduce(DataFrame.unionByName, layers), books[:-1]), "layer")
            discard(*layers)
            layers = [merged]
        layers.append(materialize(_owned(_movers(reduce(DataFrame.unionByName, layers), books)), "layer"))
    discard(*layers)
    return books[-1]


def encode(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits for each part's entry) and ``error``, the squared distances' sum, instead of ``x``."""
    n_parts, _, width = codebooks.shape
    bound_batches(vectors.sparkSession)
    keep = [c for c in vectors.columns if c != "x"]

    def stage(batches):
        for batch in batches:
            x = matrix(batch.column(len(keep)), n_parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], codebooks[p]) for p in range(n_parts)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            codes = pa.array([r.tobytes().hex() for r in digits])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), codes, pa.array(sum(f[1] for f in found))], [*keep, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "x")
    return vectors.select(*keep, "x").mapInArrow(stage, f"{schema}, code string, error long")


def decode(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``codes`` with ``x``, the integer vector that each code stands for."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in book]) for book in codebooks])
    part = lambda p: F.get(F.get(entries, F.lit(p)), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("x", F.concat(*[part(p) for p in range(len(codebooks))]))


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, scale: int = 4096, n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row that has a vector.

    Rows without a usable vector go, as ``integer_vectors`` says. Repeated rows
    each count and each get a row; a null vec_id seeds an entry only after all
    others. label_error sums the errors of equal labels, null ones together. An
    empty table gives an empty result; a number of components that ``n_parts`` doesn't
    divide raises a ValueError. Other columns are ignored.
    """
    vectors, size = integer_vectors(embeddings, scale, ["vec_id", "label"])
    books = fit_codebooks(vectors, size, n_parts, n_entries, rounds) if size else np.zeros((n_parts, 1, 0), np.int64)
    coded = materialize(encode(vectors, books), "coded")
    keyed = coded.withColumns({"_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "_null": F.col("label").isNull()})
    sums = keyed.groupBy("_label", "_null").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    joined = join_hot(keyed, sums, ["_label", "_null"], "_n")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def oracle(scale: int = 4096, n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> str:
    """The same rounds as SQL, with every part against every entry."""
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT r, p, v, arg_min(e, d * {n_entries} + e) AS e, min(d) AS d FROM (
    SELECT m.r, m.p, m.v, c.e, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(m.v, c.v)])::BIGINT AS d FROM parts m JOIN c{k} c USING (p)) GROUP BY 1, 2, 3)"""  # noqa: E731
    step = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT p, c.e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT p, e, list(floor_div ORDER BY j) AS v FROM (
    SELECT p, e, j, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_div FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS j FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (p, e))"""  # noqa: E731
    rest = ", ".join(f"{near(k)}, {step(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {n_parts} + 1 : (p + 1) * len(v) // {n_parts}] AS v FROM (SELECT r, v, unnest(range({n_parts})) AS p FROM kept)),
  low AS (SELECT vec_id, min(r) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept GROUP BY 1 ORDER BY vec_id LIMIT {n_entries}),
  c0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN low USING (r)), {rest}, {near(rounds)},
  coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS j FROM c{rounds})) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
