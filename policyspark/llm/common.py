"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python. Documents can be long, so
#: a batch of the default 10,000 rows could exceed a worker's memory.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
#: Bytes of results after which a Python stage hands a batch back.
OUT_BYTES = 8 << 20

#: What a Python worker keeps from task to task, by name. A worker outlives a query, so tasks of other stages clear it.
CACHES: dict[str, dict] = {}


def cache_of_worker(name: str) -> dict:
    return CACHES.setdefault(name, {})


def clear_others(name: str) -> None:
    for own, held in CACHES.items():
        if own != name:
            held.clear()


def give_back() -> None:
    """Hand memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(stage: Callable[[Iterator], Iterator], cache: str = "") -> Callable[[Iterator], Iterator]:
    """``stage`` for mapInArrow, in a worker that holds no other cache than ``cache`` and, after the task, no freed memory."""

    def run(batches):
        clear_others(cache)
        yield from stage(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows and bytes, since texts can be long.

    These are settings of the session, read when a query runs, so they stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where all are one process, a temporary one will do.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="policyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts lineage in a way that survives the loss of executors. What only later
    tables were made from can go by :func:`discard`; the rest is the caller's
    to clear with the folder, since results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, by_key: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``by_key``, a row a key with the number of its rows in ``size``.

    Keys with over 1/``share`` of all rows, of which there are at most
    ``share``, are broadcast, so no task gets a hot key; others meet by a shuffle.
    """
    total = by_key.agg(F.sum(size)).first()[0] or 0
    hot = by_key.where(F.col(size) * share > total).drop(size)
    rest = by_key.where(F.col(size) * share <= total).drop(size)
    calm = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(calm)


def contract(edges: DataFrame) -> DataFrame:
    """Alternating large and small stars: (u, root) for every u that isn't a root.

    Both joins of a round merge what is shuffled by u anyway: as broadcasts, a
    round's two tables would go through the driver, which holds them on until
    it collects its garbage.
    """

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    edges = materialize(edges.where("u <> v"), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before, last = state, edges
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both).select("u", F.least("u", "m").alias("m")).hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = lowest(down)
        small = down.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        discard(last)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: The code points that Unicode calls White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with the word after it. No tokenizer here lets a token
#: begin in a word and go on into the white space after it.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
