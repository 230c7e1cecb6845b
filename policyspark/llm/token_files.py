"""Token-ID files: tokenised documents as coded, checksummed blocks of ids.

Documents are dealt by ranges of doc_id and sorted, so a file set holds one
stream of ids in ascending doc_id order. A row of the container (Parquet) is a
frame: the documents' ids and lengths and the blocks of :mod:`codec`, about
``FRAME`` ids of whole documents. A frame can be read without any other; the
position of its first id in the whole stream is a sum over the frames before it.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm import codec, memo
from policyspark.llm.common import bound_batches, lean, materialize, shared_dir, shuffle_partitions

#: Ids after which a frame closes; a longer document makes a longer frame.
FRAME = 1 << 22
_SIZES = struct.Struct("<III")
#: Times the encoder's usual memo and cuts, since nothing else of size is held here but a frame's ids.
ROOM = 4
#: Frames up to which their first positions are broadcast; more meet them by a shuffle.
STARTS = 1 << 20
FRAMES = "part long, frame long, n_ids long, body binary"


def pack_frame(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    blocks = codec.encode_blocks(np.frombuffer(b"".join(ids), "<u4"))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    lens = np.array([len(x) // 4 for x in ids], "<u4")
    sizes = np.array([len(b) for b in blocks], "<u4")
    return _SIZES.pack(len(ids), len(blocks), 1) + nulls.tobytes() + keys.tobytes() + lens.tobytes() + sizes.tobytes() + b"".join(blocks)


def unpack_frame(body: bytes) -> tuple[list[int | None], list[bytes]]:
    docs, blocks, _ = _SIZES.unpack_from(body)
    at, parts = _SIZES.size, []
    for dtype, n in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", blocks)):
        parts.append(np.frombuffer(body, dtype, n, at))
        at += parts[-1].nbytes
    nulls, keys, lens, sizes = parts
    ends = at + np.cumsum(sizes, dtype=np.int64)
    found = codec.decode_blocks([body[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())])
    raw = np.concatenate([*found, np.zeros(0, np.int64)]).astype("<u4").tobytes()
    stops = 4 * np.cumsum(lens, dtype=np.int64)
    return [None if z else k for z, k in zip(nulls.tolist(), keys.tolist())], [raw[e - 4 * n : e] for e, n in zip(stops.tolist(), lens.tolist())]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode whole texts, append ``end_id`` to each document and write frames to ``path``.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are
    written once each, side by side, in the order of their texts; a null doc_id
    comes first. A text of any length lies in one frame and is coded in groups
    of blocks of bounded memory. An empty table gives files without frames;
    other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def stage(batches):
        enc, part, frame = memo.encoder(tokenizer, ROOM), TaskContext.get().partitionId(), 0
        keys, held, total = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([frame], pa.int64()), pa.array([total], pa.int64()), pa.array([pack_frame(keys, held)], pa.binary())], ["part", "frame", "n_ids", "body"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                if total and total + len(ids) // 4 >= FRAME:
                    yield row()
                    keys, held, total, frame = [], [], 0, frame + 1
                keys.append(key)
                held.append(ids + end)
                total += len(ids) // 4 + 1
        if keys:
            yield row()

    n = shuffle_partitions(spark)
    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lean(stage, memo.ENCODERS), FRAMES).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of each document in the files at ``path``; no rows if they hold none."""
    bound_batches(spark)
    frames = spark.read.schema(FRAMES).parquet(path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("part_start"))  # a row for each range
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(frames.select("part", "frame", own.alias("own")).join(parts, "part").select("part", "frame", (F.col("own") + F.col("part_start")).alias("base")), "starts")
    # a row of 24 bytes for each frame of some four million ids; frames meet it before they are decoded
    few = F.broadcast(starts) if starts.count() <= STARTS else starts

    def stage(batches):
        for batch in batches:
            for base, body in zip(*(batch.column(i).to_pylist() for i in range(2))):
                keys, ids = unpack_frame(body)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                at = base + np.cumsum(n) - n
                for i in range(0, len(keys), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 256], pa.int64()), pa.array(at[i : i + 256], pa.int64()), pa.array(n[i : i + 256], pa.int64()), pa.array(ids[i : i + 256], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = frames.select("part", "frame", "body").join(few, ["part", "frame"]).select("base", "body")
    return placed.mapInArrow(lean(stage), "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
