"""Sources and sinks (A1-A10): tasks, pages, records, results, findings."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions.normalize import strip
from policyspark.operators import rules
from policyspark.operators.stages import settle

RECORD = ", ".join(f"{p} string" for p in packs.PARAMS) + ", reasoning string, estimated_access_score string, corrections array<string>"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A1: (filename, brand) rows of a CSV; blank ones go, repeats stay."""
    rows = spark.read.option("header", True).csv(path).select(strip(F.col("filename")).alias("filename"), strip(F.col("brand")).alias("brand"))
    return rows.where("filename <> '' and brand <> ''").withColumn("row_no", F.monotonically_increasing_id())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON records, all values as text; unreadable ones are missing."""
    return spark.read.schema(RECORD).option("multiLine", True).option("primitivesAsString", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.col("_metadata.file_name"))


def write_records(records: DataFrame, path: str) -> None:
    """A4: normalised and appended, by pass and provider."""
    rows = rules.normalize_records(records)
    rows.select(*[c for c in records.columns if c in rows.columns]).write.mode("append").partitionBy("pass_name", "provider").parquet(path)


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """A3: what :func:`write_records` stored, with file, brand, pass and provider; a provider without a name is ''."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("provider", F.coalesce(F.col("provider").cast("string"), F.lit("")))


def _partition_folders(spark: SparkSession, path: str) -> dict[str, tuple]:
    """Folder of each partition that has rows, and its pass and provider; partitions are few."""
    read = stored_records(spark, path).select("pass_name", "provider", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"))
    return {r["folder"]: (r["pass_name"], r["provider"]) for r in read.distinct().collect()}


def _drop_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def keep_provider(spark: SparkSession, path: str, provider: str) -> list[str]:
    """A10: drops the partitions of other providers from a store of :func:`write_records`; returns their folders. Other files stay as they are."""
    gone = [f for f, (_, p) in _partition_folders(spark, path).items() if p != provider]
    _drop_folders(spark, gone)
    return gone


def drop_stale_validated(spark: SparkSession, path: str, revised: DataFrame) -> list[str]:
    """A10: drops the validated records of ``revised`` tasks; returns the folders that were written anew or dropped.

    Only partitions that have such records are rewritten, by dynamic overwrite, from a settled copy of what stays.
    """
    stale = revised.select("filename", "brand").distinct()
    old = stored_records(spark, path).where("pass_name = 'validate'")
    hit = [r[0] for r in old.join(stale, ["filename", "brand"], "left_semi").select("provider").distinct().collect()]
    if not hit:
        return []
    touched = {f: p for f, (n, p) in _partition_folders(spark, path).items() if n == "validate" and p in hit}
    kept = settle(old.where(F.col("provider").isin(hit)).join(stale, ["filename", "brand"], "left_anti"))
    left = {r[0] for r in kept.select("provider").distinct().collect()}
    if left:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass_name", "provider").parquet(path)
    _drop_folders(spark, [f for f, p in touched.items() if p not in left])
    return list(touched)


def output_table(rows: DataFrame) -> DataFrame:
    """A5: exact columns in order, stripped, null as ''."""
    named = rows.withColumnsRenamed({"filename": "Filename", "brand": "Brand", "access_score": "Access Score", **packs.PARAM_COLUMNS})
    return named.select(*[F.coalesce(strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in packs.OUTPUT_COLUMNS])


def write_results(rows: DataFrame, path: str) -> None:
    output_table(rows).write.option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results back under their parameter names, for re-scoring."""
    back = {v: k for k, v in packs.PARAM_COLUMNS.items()} | {"Filename": "filename", "Brand": "brand", "Access Score": "access_score"}
    rows = spark.read.option("header", True).csv(path).withColumnsRenamed(back)
    return rows.withColumn("access_score", F.col("access_score").try_cast("int"))


def write_findings(findings: DataFrame, path: str, run_id: str) -> None:
    """A run's findings replace what the same run wrote before, also where there are none now."""
    findings.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={quote(run_id, safe='')}")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/run_id=*")


def filtered(rows: DataFrame, filename: str = "All", brand: str = "All") -> DataFrame:
    """Rows of one file and one brand; "All" keeps every one."""
    if filename != "All":
        rows = rows.where(F.col("filename") == filename)
    return rows if brand == "All" else rows.where(F.col("brand") == brand)


def selected(tasks: DataFrame, brands: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """B2: tasks of some brands, or of explicit (filename, brand) pairs."""
    if brands:
        tasks = tasks.where(F.col("brand").isin(brands))
    return tasks if pairs is None else tasks.join(pairs.select("filename", "brand"), ["filename", "brand"], "left_semi")


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Filename, brand and prompt of each task."""
    prompts.select("filename", "brand", "prompt").write.mode("overwrite").parquet(path)


def first_tasks(tasks: DataFrame, filename: str | None = None, brand: str | None = None, n: int | None = None) -> DataFrame:
    """B1: tasks of a file, then of a brand (only with a file), then the first n in order."""
    if filename:
        tasks = tasks.where(F.col("filename") == filename)
        if brand:
            tasks = tasks.where(F.col("brand") == brand)
    return tasks.orderBy("row_no").limit(n) if n else tasks
