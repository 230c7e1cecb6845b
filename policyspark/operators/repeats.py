"""Pages that share a text are looked at once: work on texts, for as many texts as there are.

Boilerplate repeats from document to document. Where a table has few distinct texts, its rows carry
their text's number, a look at a text is taken once and joined to the rows by that number; where it has many,
every row is looked at itself. The results are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.operators.stages import settle

Look = Callable[[DataFrame], DataFrame]
#: Distinct texts, and their characters, up to which what was found in them is sent to every task; with brands, five times as many pairs.
FEW, FEW_CHARS = 20_000, 8_000_000
#: Rows up to which a table without texts is sent to every task; characters up to which one with texts is.
SHORT, SHORT_CHARS = 20_000, 64_000_000


def sent(df: DataFrame) -> DataFrame:
    """A settled table without texts, sent to every task if it is short."""
    return F.broadcast(df) if df.count() <= SHORT else df


def _sent_found(found: DataFrame) -> DataFrame:
    chars = found.agg(F.sum(F.length(F.to_json(F.struct(*found.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(found) if chars <= SHORT_CHARS else found


class Texts:
    """The texts of ``pages``, whatever their other columns are.

    ``rows`` are the pages with ``text`` or, if the distinct texts are few, with the number of it, ``text_no``, from 0.
    """

    def __init__(self, pages: DataFrame, tasks: DataFrame | None = None):
        """``tasks``: those whose brands the texts are looked at with."""
        self.pages, self.tasks = pages, tasks

    @cached_property
    def few(self) -> DataFrame | None:
        """text_no and text of the distinct texts, null among them; None if they are many."""
        parts = int(self.pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if self.pages.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0] > FEW:
            return None
        texts = settle(self.pages.select("text").distinct())
        n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        brands = 1 if self.tasks is None else self.tasks.select("brand").distinct().count()
        if n > FEW or chars > FEW_CHARS or n * brands > 5 * FEW:
            return None
        order = F.array_sort(F.collect_list(F.struct("text")))
        return settle(texts.agg(order.alias("t")).select(F.posexplode("t").alias("text_no", "t")).select("text_no", "t.text").repartition(parts, "text_no"))

    @cached_property
    def rows(self) -> DataFrame:
        if self.few is None:
            return self.pages
        few = F.broadcast(self.few.withColumnRenamed("text", "_text"))
        return self.pages.join(few, F.col("text").eqNullSafe(F.col("_text"))).drop("text", "_text")

    @property
    def key(self) -> str:
        return "text" if self.few is None else "text_no"

    def seen(self, rows: DataFrame, look: Look, brands: DataFrame | None = None) -> DataFrame:
        """``look(rows)`` for some of ``rows``, with their text if it is asked for.

        ``look`` goes by a row's text alone, or with ``brands`` by text and brand. It keeps the columns it gets,
        adds its own and makes any number of rows of one.
        """
        if self.few is None:
            return look(rows)
        if brands is None:
            found = settle(look(self.few)).withColumnRenamed("text_no", "_no")
            return rows.join(_sent_found(found), F.col("text_no") == F.col("_no")).drop("_no")
        found = settle(look(self.few.crossJoin(F.broadcast(brands)))).withColumnsRenamed({"text_no": "_no", "brand": "_brand"})
        return rows.join(_sent_found(found), (F.col("text_no") == F.col("_no")) & F.col("brand").eqNullSafe(F.col("_brand"))).drop("_no", "_brand")
