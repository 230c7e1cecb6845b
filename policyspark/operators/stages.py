"""Stages that run once: what a costly step made is settled before the next step looks at it."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that ``spark.checkpoint.dir`` names, so that it outlives its executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="policyspark-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def first_that_answers(tasks: DataFrame, keys: list[str], stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """U4: each task's row of the first stage that has one for it, with ``stage``, the stage's name.

    A stage is a function of the tasks that no earlier stage has answered, found by an anti join with those
    stages' settled rows; it isn't called when none are left. Tasks that no stage answers have no row.
    """
    done, left = [], tasks
    for name, stage in stages.items():
        if done and left.isEmpty():
            break
        done.append(settle(stage(left).withColumn("stage", F.lit(name))))
        left = left.join(done[-1].select(*keys).distinct(), keys, "left_anti")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
