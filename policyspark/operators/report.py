"""Aggregates of reports (D1-D9, D17) and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brand_summary(rows: DataFrame) -> DataFrame:
    whole = lambda c: F.coalesce(F.rint(c).cast("int").cast("string"), F.lit("NA"))
    return rows.groupBy("brand").agg(F.count("*").alias("n"), whole(F.avg("access_score")).alias("mean_score"), whole(F.min("access_score")).alias("min_score"), whole(F.max("access_score")).alias("max_score"))


def score_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("access_score").agg(F.count("*").alias("n")).orderBy("access_score")


def brand_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("brand").agg(F.avg("access_score").alias("m")).na.drop().select("brand", F.rint("m").cast("int").alias("mean_score")).orderBy("mean_score", "brand")


def step_burden(rows: DataFrame) -> DataFrame:
    count = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("int")).otherwise(0)
    mean = lambda c: (F.rint(F.avg(count(c)) * 10) / 10)
    by = rows.groupBy("brand").agg(mean("steps_through_brands").alias("branded"), mean("steps_through_generic").alias("generic"))
    return by.withColumn("total", F.rint((F.col("branded") + F.col("generic")) * 10) / 10).orderBy("total", "brand")


def burden_long(burden: DataFrame) -> DataFrame:
    return burden.melt(["brand"], ["branded", "generic"], "kind", "steps")


def kpis(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of totals; the share of distinct tasks that have a result."""
    done = tasks.select("filename", "brand").distinct().join(rows.select("filename", "brand", F.lit(1).alias("hit")).distinct(), ["filename", "brand"], "left").agg(F.count("*").alias("n_tasks"), F.count("hit").alias("n_done"))
    totals = rows.agg(F.count("*").alias("n"), F.avg("access_score").alias("mean_score"), F.min("access_score").alias("min_score"), F.max("access_score").alias("max_score"), F.count_distinct("brand").alias("n_brands"))
    share = F.when(F.col("n_tasks") == 0, 0.0).otherwise(F.col("n_done") * 100.0 / F.col("n_tasks"))
    return totals.withColumn("k", F.lit(1)).join(done.withColumn("k", F.lit(1)), "k").select("n", "mean_score", "min_score", "max_score", "n_brands", "n_tasks", share.alias("done_pct"))


def completion(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """How many of a file's tasks have a record."""
    keys = records.select("filename", "brand", F.lit(1).alias("hit")).distinct()
    by = tasks.select("filename", "brand").join(keys, ["filename", "brand"], "left").groupBy("filename").agg(F.count("*").alias("n_tasks"), F.count("hit").alias("n_done"))
    return by.withColumn("state", F.when(F.col("n_done") == F.col("n_tasks"), "all").when(F.col("n_done") > 0, "any").otherwise("none"))


def relevance_band(relevance: Column) -> Column:
    return F.when(relevance >= 8, "strong").when(relevance >= 3, "moderate").when(relevance > 0, "weak").otherwise("none")


def context_reduction(pages: DataFrame, least: float) -> DataFrame:
    """Characters of pages at or above a relevance, against all."""
    kept = F.sum(F.when(F.col("relevance") >= least, F.length("text")).otherwise(0))
    by = pages.groupBy("filename", "brand").agg(F.sum(F.length("text")).alias("raw_chars"), kept.alias("kept_chars"))
    return by.withColumn("reduction", F.when(F.col("raw_chars") == 0, 0.0).otherwise(1.0 - F.col("kept_chars") / F.col("raw_chars")))


def page_profile(pages: DataFrame) -> DataFrame:
    """Page number from one, score, categories, size and the first 80 characters."""
    return pages.select("filename", "brand", (F.col("page_num") + 1).alias("page"), "relevance", F.array_join(F.array_sort("categories"), ", ").alias("categories"), F.length("text").alias("chars"), F.translate(F.substring("text", 1, 80), "\n", " ").alias("preview"))


def run_totals(rows: DataFrame) -> DataFrame:
    """Rule fixes, warnings and rows without a score, in one pass over the results."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return rows.agg(total("violations").alias("n_fixes"), F.count(F.when(F.col("access_score").isNull(), 1)).alias("n_unscored"), total("findings").alias("n_findings"))


def provider_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("provider").agg(F.count("*").alias("n"))


def confidence_counts(rows: DataFrame) -> DataFrame:
    """One row with the number of High, Medium and Low rows; others count for nothing."""
    return rows.agg(*[F.count(F.when(F.col("level") == n, 1)).alias(n.lower()) for n in ("High", "Medium", "Low")])


def not_high(rows: DataFrame) -> DataFrame:
    """Rows whose confidence is not High, for review.

    Not a plain filter: pushed below the projections that make the confidence, it would repeat the chain of scores.
    """
    kept = F.filter(F.array(F.struct(*rows.columns)), lambda r: r["level"] != "High")
    return rows.select(F.explode(kept).alias("r")).select("r.*")


def file_brands(tasks: DataFrame) -> DataFrame:
    """Each file's distinct brands, in the order of their first row."""
    first = tasks.groupBy("filename", "brand").agg(F.min("row_no").alias("at"))
    brands = F.transform(F.array_sort(F.collect_list(F.struct("at", "brand"))), lambda x: x["brand"])
    return first.groupBy("filename").agg(F.count("*").alias("n_brands"), F.array_join(brands, ", ").alias("brands"))


def run_statistics(calls: DataFrame) -> DataFrame:
    """Calls, hits and tokens (a quarter of the characters) by provider, from a log of calls."""
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.floor(F.sum("chars") / 4).cast("long").alias("tokens"))


def dry_run_by_type(packages: DataFrame) -> DataFrame:
    """Tasks, characters and tokens by document type and preferred status."""
    n = F.length("full_text")
    return packages.groupBy("document_type", "preferred_status").agg(F.count("*").alias("n_tasks"), F.sum(n).alias("chars"), F.floor(F.sum(n) / 4).cast("long").alias("tokens"))
