"""Exact deduplication by skew-safe combining, full content compared at every stage.

1. local: a task reads its rows in slices of a few megabytes and keeps one
   winner of each content of a slice, with the ids of the slice's copies;
2. salted: winners meet by (digest, salt), where windows over (digest, content)
   compare them. A digest has one salt, unless it has over a ``SHARE`` of the
   winners: then it is dealt into parts of about that share. At most 1/``SHARE``
   digests can be that hot, so they are broadcast;
3. global: the salted winners of those few digests meet by (digest, content).

A text goes through one shuffle. Members find their class within the windows
that compare contents, so nothing is joined back by a digest alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from policyspark.llm.bpe import slices
from policyspark.llm.common import bound_batches, lean, materialize, shuffle_partitions, text_or_empty

#: Runs of these characters count as one space.
SPACES = r"[\x20\x09-\x0D]+"
#: Share of all local winners, as one in so many, beyond which a digest is salted.
SHARE = 1000
_RUNS = re.compile("[\t-\r][\t-\r ]*| [\t-\r ]+")


def normalise(column: Column) -> Column:
    return F.regexp_replace(column, SPACES, " ")


def normal_text(text: str | None) -> str:
    """The same in Python: only runs that aren't a single space already are replaced."""
    return _RUNS.sub(" ", text or "")


def _local(docs: DataFrame, wins: list[str]) -> DataFrame:
    """Local winners: the columns ``wins`` of the row with the smallest (doc_id, others), with digest and ids.

    Whole texts are compared; ``ids`` are the doc_ids of a slice's rows of one content.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in wins])
    schema = StructType([*rows.schema.fields]).add("_digest", StringType()).add("_ids", ArrayType(LongType())).add("_row", LongType())

    def stage(batches):
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            ids, texts = batch.column(at["doc_id"]).to_pylist(), batch.column(at["text"]).to_pylist()
            rest = [batch.column(i) for n, i in at.items() if n not in ("doc_id", "text")]

            def order(i: int) -> tuple:
                return ids[i] is None, ids[i] or 0, texts[i] or "", [str(c[i]) for c in rest]

            for a, b in slices(texts):
                groups: dict[str, list[int]] = {}
                for i in range(a, b):
                    groups.setdefault(normal_text(texts[i]), []).append(i)
                first = batch.take(pa.array([g[0] if len(g) == 1 else min(g, key=order) for g in groups.values()]))
                digests = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in groups])
                copies = pa.array([[ids[i] for i in g] for g in groups.values()], pa.list_(pa.int64()))
                numbers = pa.array(range(row, row + len(groups)), pa.int64())
                row += len(groups)
                yield pa.RecordBatch.from_arrays([*first.columns, digests, copies, numbers], [*batch.schema.names, "_digest", "_ids", "_row"])

    return materialize(rows.mapInArrow(lean(stage), schema), "local")


def _salted(local: DataFrame) -> DataFrame:
    """``local`` with ``_hot`` and ``_salt``; ``_row`` deals the winners of a hot digest out."""
    counts = local.groupBy("_digest").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # digests with over 1/SHARE of the rows number at most SHARE, so this side has a fixed bound
    hot = materialize(counts.where(F.col("n") * SHARE > total).where("n > 1").select("_digest", F.ceil(F.col("n") * SHARE / F.lit(max(1, total))).alias("_parts")), "hot")
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_row"), F.col("_parts"))).otherwise(F.lit(0)).alias("_salt")
    return local.join(F.broadcast(hot), "_digest", "left").select(*local.columns, salt, F.col("_parts").isNotNull().alias("_hot"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "_digest", "_salt").withColumn("_norm", normalise(text_or_empty()))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. Of equal texts
    the smallest doc_id stays (a null doc_id only where there is no other).
    Rows that repeat a doc_id with the same text count singly in group_size and
    are all marked kept if they carry the winning id. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    local = _local(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"])
    rows = _salted(local)
    own = Window.partitionBy("_digest", "_salt", "_norm")
    keep, n = F.min("doc_id").over(own).alias("keep"), F.sum(F.size("_ids").cast("long")).over(own).alias("n")
    # a winner of each salted content of a hot digest, of which there are at most about 2 * SHARE
    winners = _dealt(rows.where("_hot")).groupBy("_digest", "_salt", "_norm").agg(F.min("doc_id").alias("k"), F.sum(F.size("_ids").cast("long")).alias("n"))
    whole = Window.partitionBy("_digest", "_norm")
    final = materialize(winners.select(F.col("_digest").alias("d"), F.col("_salt").alias("s"), "k", F.min("k").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("size")), "winners")
    same = (F.col("_digest") == F.col("d")) & (F.col("_salt") == F.col("s")) & F.col("keep").eqNullSafe(F.col("k"))
    members = _dealt(rows).select("_digest", "_salt", "_hot", "_ids", keep, n).join(F.broadcast(final), same, "left")
    found = members.select(
        F.explode("_ids").alias("doc_id"),
        F.when(F.col("_hot"), F.col("keep_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(F.col("_hot"), F.col("size")).otherwise(F.col("n")).alias("group_size"),
        F.col("_digest").alias("text_sha256"),
    )
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller doc_id has.

    Equal texts are those of :func:`exact_groups`; null and empty texts are
    equal, and a row with a null doc_id stays only where its text has no other.
    Of rows with equal text and doc_id one stays. Other columns come along
    unchanged, whatever their names; an empty table gives an empty one.
    """
    names = {c: f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)}
    local = _local(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), list(names.values()))
    rows = _dealt(_salted(local))
    rank = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    place = F.row_number().over(Window.partitionBy("_digest", "_salt", "_norm").orderBy(*rank))
    first = rows.withColumn("_place", place).where("_place = 1")
    again = F.row_number().over(Window.partitionBy("_digest", "_norm").orderBy(*rank))
    hot = first.where("_hot").withColumn("_place", again).where("_place = 1")
    kept = first.where("not _hot").unionByName(hot)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
