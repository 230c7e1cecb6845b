"""Checks across rows: consistency (D10), drift (D11), completeness (D12), expected pairs (F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark import packs


def consistency(rows: DataFrame) -> DataFrame:
    """Columns that differ between the brands of a file more than they may."""
    names = [*packs.MUST_MATCH, *packs.MUST_BE_NEAR]
    long = rows.melt(["filename", "brand"], names, "column", "value")
    number = F.when(F.col("value").rlike(r"^\s*[+-]?\d+\s*$"), F.col("value").try_cast("int"))
    by = long.groupBy("filename", "column").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("value", F.lit("NA"))).alias("n_values"), (F.max(number) - F.min(number)).alias("spread"))
    near = F.when(F.lit(False), F.lit(0))
    for c, t in packs.MUST_BE_NEAR.items():
        near = near.when(F.col("column") == c, t)
    bad = F.when(F.col("column").isin(packs.MUST_MATCH), F.col("n_values") > 1).otherwise(F.col("spread") > near)
    return by.where((F.col("n") >= 2) & bad).select("filename", "column", "n_values", F.when(~F.col("column").isin(packs.MUST_MATCH), F.col("spread")).alias("spread"))


def drift(rows: DataFrame, expected: DataFrame, least_rows: int = 5, tolerance: float = 25.0) -> DataFrame:
    """Shares of a value that stray from the expected by more than ``tolerance`` points.

    ``expected``: brand, column, value, pct; a small dimension.
    """
    names = packs.PARAMS
    totals = rows.groupBy("brand").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least_rows)
    counts = rows.melt(["filename", "brand"], names, "column", "value").groupBy("brand", "column", "value").agg(F.count("*").alias("n"))
    known = expected.join(totals, "brand").join(counts, ["brand", "column", "value"], "left")
    actual = F.coalesce("n", F.lit(0)) * 100.0 / F.col("n_rows")
    return known.select("brand", "column", "value", "pct", actual.alias("actual_pct")).where(F.abs(F.col("actual_pct") - F.col("pct")) > tolerance)


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing columns, and null or blank values."""
    there = [c for c in columns if c in rows.columns]
    gaps = rows.withColumns({c: F.col(c).cast("string") for c in there}).select(F.col("filename").alias("f"), F.col("brand").alias("b"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in there])).alias("x"))
    empty = gaps.where(F.col("x.value").isNull() | (F.trim("x.value") == "")).select(F.col("f").alias("filename"), F.col("b").alias("brand"), F.col("x.column").alias("column"), F.lit("empty").alias("kind"))
    missing = rows.select("filename", "brand", F.explode(F.array(*[F.lit(c) for c in columns if c not in rows.columns]).cast("array<string>")).alias("column"), F.lit("missing").alias("kind"))
    return empty.unionByName(missing)


def pair_gaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(filename, brand) pairs that are expected only or there only."""
    e, a = expected.select("filename", "brand"), actual.select("filename", "brand")
    return e.subtract(a).withColumn("kind", F.lit("missing")).unionByName(a.subtract(e).withColumn("kind", F.lit("extra")))
