"""Findings of all checks in one shape (F3): kind, filename, brand, column, detail, message.

``detail`` has the values that a finding is about, as text. What a check doesn't
speak of (a brand, a column) is null, so rows of every check lie one under the other
and can be filtered, counted or stored together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from policyspark.sources import tables

SCHEMA = ["kind", "filename", "brand", "column", "detail", "message"]


def _shaped(rows: DataFrame, kind: Column | str, column: Column | str | None, detail: list[str], message: Column) -> DataFrame:
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    pairs = F.map_from_arrays(F.array(*[F.lit(d) for d in detail]).cast("array<string>"), F.array(*[F.col(d).cast("string") for d in detail]).cast("array<string>"))
    named = F.lit(column) if isinstance(column, str) or column is None else column
    return rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), own("filename").cast("string").alias("filename"), own("brand").cast("string").alias("brand"), named.cast("string").alias("column"), pairs.alias("detail"), message.alias("message"))


def of_consistency(rows: DataFrame) -> DataFrame:
    """D10."""
    said = F.concat(F.col("column"), F.lit(" differs between the brands of the file"))
    return _shaped(rows, "inconsistent", F.col("column"), ["n_values", "spread"], said)


def of_drift(rows: DataFrame) -> DataFrame:
    """D11."""
    said = F.concat(F.col("column"), F.lit(" = "), F.col("value"), F.lit(" is as common as it shouldn't be"))
    return _shaped(rows, "drift", F.col("column"), ["value", "pct", "actual_pct"], said)


def of_completeness(rows: DataFrame) -> DataFrame:
    """D12."""
    return _shaped(rows.withColumnRenamed("kind", "gap"), "incomplete", F.col("column"), ["gap"], F.concat(F.col("column"), F.lit(" is "), F.col("gap")))


def of_pairs(rows: DataFrame) -> DataFrame:
    """expected pairs that aren't there, and the other way round."""
    return _shaped(rows.withColumnRenamed("kind", "pair"), "pair", None, ["pair"], F.concat(F.lit("pair is "), F.col("pair")))


def of_sanity(rows: DataFrame) -> DataFrame:
    """G17."""
    return _shaped(rows, "score", "access_score", ["finding", "access_score"], F.col("finding"))


def of_rules(rows: DataFrame) -> DataFrame:
    """R: a row for each rule that changed a record."""
    broken = rows.select("filename", "brand", F.explode_outer("violations").alias("rule")).where("rule is not null")
    return _shaped(broken, "rule", None, ["rule"], F.concat(F.lit("corrected by "), F.col("rule")))


def of_fallback(rows: DataFrame) -> DataFrame:
    """U4: tasks that no stage answered."""
    return _shaped(rows, "review", None, [], F.col("message"))


def together(*parts: DataFrame) -> DataFrame:
    """findings of several checks one under the other."""
    return reduce(DataFrame.unionByName, [p.select(*SCHEMA) for p in parts])


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind", "column").agg(F.count("*").alias("n"))


def write_results_counted(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes results (with ``violations`` and ``findings``) and returns the run's totals, counted while they are written."""
    seen = Observation("run totals")
    sums = [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.size("violations")), F.lit(0)).alias("n_fixes"), F.count(F.when(F.col("access_score").isNull(), 1)).alias("n_unscored"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("n_findings")]
    tables.write_results(rows.observe(seen, *sums), path)
    return {k: int(v) for k, v in seen.get.items()}
