"""Persisted records: best of a task (C2), pending tasks (C3), diffs (C6), merges (C8, C9, D13), retention (A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions.normalize import strip

PASSES, PROVIDERS = ["validate", "extract"], ["groq-optimized", "groq", ""]
# Fields in which a rule's value wins over a model's.
RULES_FIRST = ["age", "steps_through_brands", "steps_through_generic", "step_through_phototherapy", "tb_test_required", "quantity_limits", "specialist_types", "initial_auth_duration", "reauth_duration", "reauth_required"]


def rank_of(c: str, order: list[str]) -> Column:
    found = F.when(F.lit(False), F.lit(0))
    for k, v in enumerate(order):
        found = found.when(F.col(c) == v, k)
    return found.otherwise(len(order))


def best_records(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Each task's record, validated before extracted, then by provider.

    The best of a key is taken by one aggregation, whose map side leaves one
    row a key, rather than by a window. Tasks without a record are left out.
    """
    rest = [c for c in records.columns if c not in ("filename", "brand")]
    order = F.struct(rank_of("pass_name", PASSES).alias("p"), rank_of("provider", PROVIDERS).alias("q"), *rest)
    best = records.groupBy("filename", "brand").agg(F.min(order).alias("r")).select("filename", "brand", *[F.col("r")[c].alias(c) for c in rest])
    return tasks.join(best, ["filename", "brand"])


def pending(tasks: DataFrame, records: DataFrame) -> DataFrame:
    return tasks.join(records.select("filename", "brand"), ["filename", "brand"], "left_anti")


def hits(tasks: DataFrame, records: DataFrame) -> DataFrame:
    return tasks.join(records.select("filename", "brand"), ["filename", "brand"], "left_semi")


def keep_provider(records: DataFrame, provider: str) -> DataFrame:
    """A10: without the records of other providers."""
    return records.where(F.coalesce(F.col("provider"), F.lit("")) == provider)


def drop_stale_validated(records: DataFrame, revised: DataFrame) -> DataFrame:
    """A10: without the validated records of tasks that were extracted anew."""
    stale = revised.select("filename", "brand").distinct().withColumn("pass_name", F.lit("validate"))
    return records.join(stale, ["filename", "brand", "pass_name"], "left_anti")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields that differ, compared as text."""
    long = lambda df, name: df.melt(["filename", "brand"], packs.PARAMS, "param", name)
    both = long(old, "old_value").join(long(new, "new_value"), ["filename", "brand", "param"], "full_outer")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def na_like(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(packs.MERGE_NA_FORMS)


def gap(c: Column) -> Column:
    """What a second pass may fill: fewer spellings than a merge takes for missing."""
    return c.isNull() | F.lower(strip(c)).isin(packs.GAP_FORMS)


def rules_over_model(rules: DataFrame, model: DataFrame) -> DataFrame:
    """A rule's value wins for most fields; for the rest it fills gaps."""
    r, m = rules.alias("r"), model.alias("m")
    joined = r.join(m, (F.col("r.filename") == F.col("m.filename")) & (F.col("r.brand") == F.col("m.brand")))
    out = []
    for p in packs.PARAMS:
        own, other = F.col(f"r.{p}"), F.col(f"m.{p}")
        missing = other.isNull() | other.isin("", "NA", "N/A")
        out.append((F.coalesce(own, other) if p in RULES_FIRST else F.when(missing, F.coalesce(own, other)).otherwise(other)).alias(p))
    return joined.select("r.filename", "r.brand", *out)


def fill_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second record's values only where the first has none."""
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, (F.col("a.filename") == F.col("b.filename")) & (F.col("a.brand") == F.col("b.brand")), "left")
    return joined.select("a.filename", "a.brand", *[F.when(gap(F.col(f"a.{p}")) & ~gap(F.col(f"b.{p}")), F.col(f"b.{p}")).otherwise(F.col(f"a.{p}")).alias(p) for p in packs.PARAMS])


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """One record of a task's chunk records, by each field's rule; ties go to the lower chunk_no.

    All rules but ``reasoning`` are built from aggregates that combine on the
    map side, so a task with many chunks costs one row of state.
    """
    no = F.col("chunk_no")
    aggs = [F.count("*").alias("n_chunks")]
    for p in packs.PARAMS:
        v = F.col(p)
        good = ~na_like(v)
        number = F.when(good & v.rlike(r"^\s*[+-]?\d+\s*$"), strip(v).try_cast("int"))
        longest = F.max_by(F.when(good, v), F.when(good, F.struct(F.length(v).alias("l"), (-no).alias("k"))))
        first = F.min_by(v, F.when(good, no))
        single = F.count(F.when(good, 1)) <= 1
        some_yes = F.max(F.when(good & (F.lower(strip(v)) == "yes"), 1)) == 1
        if p in ("step_through_phototherapy", "tb_test_required", "reauth_required"):
            merged = F.when(~single & some_yes, F.lit("Yes")).otherwise(first)
        elif p in ("steps_through_brands", "steps_through_generic"):
            merged = F.when(single, first).otherwise(F.coalesce(F.max(number).cast("string"), longest))
        elif p in ("initial_auth_duration", "reauth_duration"):
            merged = F.when(single, first).otherwise(F.coalesce(F.min(number).cast("string"), longest))
        elif p == "step_therapy_requirements":
            is_long = good & (F.length(v) > 20)
            long_text = F.max_by(F.when(is_long, v), F.when(is_long, F.struct(F.length(v).alias("l"), (-no).alias("k"))))
            merged = F.when(single, first).otherwise(F.coalesce(long_text, F.when(some_yes, F.lit("Yes")), first))
        else:
            merged = F.when(single, first).otherwise(longest)
        alone = F.min_by(v, no)
        aggs.append(F.when(F.count("*") == 1, alone).otherwise(F.coalesce(merged, F.lit("NA"))).alias(p))
    said = F.array_sort(F.collect_list(F.when(~na_like(F.col("reasoning")), F.struct("chunk_no", "reasoning"))))
    aggs.append(F.array_join(F.transform(said, lambda x: x["reasoning"]), " | ").alias("reasoning"))
    return chunks.groupBy("filename", "brand").agg(*aggs)


def with_defaults(tasks: DataFrame) -> DataFrame:
    """U4, last stage: default parameters of each task's brand."""
    def value(p: str) -> Column:
        own = [F.when(F.upper("brand") == b, v[p]) for b, v in packs.BRAND_DEFAULTS.items() if p in v]
        return F.coalesce(*own, F.lit(packs.DEFAULTS[p])).alias(p)

    return tasks.select("filename", "brand", *[value(p) for p in packs.PARAMS])
