"""From extracted records to the final table: normalise (N*), rename (B4, V*), business rules (R*), score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions import normalize, score
from policyspark.functions.normalize import whole_number


def _staged(df: DataFrame, number) -> tuple[DataFrame, dict]:
    """``df`` with each parameter stripped, lower-cased and read as a number, in three projections."""
    names = [p for p in packs.PARAMS if p in df.columns]
    df = df.withColumns({f"_own_{p}": normalize.strip(F.col(p).cast("string")) for p in names})
    df = df.withColumns({f"_low_{p}": F.lower(f"_own_{p}") for p in names})
    df = df.withColumns({f"_n_{p}": number(p) for p in names})
    return df, {p: (F.col(f"_own_{p}"), F.col(f"_low_{p}"), F.col(f"_n_{p}")) for p in names}


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def normalize_records(df: DataFrame) -> DataFrame:
    """Each parameter normalised once; other columns stay. A null is the text 'None'."""
    df = df.withColumns({p: F.coalesce(F.col(p).cast("string"), F.lit("None")) for p in packs.PARAMS if p in df.columns})
    counted = ("steps_through_brands", "steps_through_generic", "initial_auth_duration", "reauth_duration")
    staged, values = _staged(df, lambda p: normalize.first_number(F.col(f"_low_{p}")) if p in counted else F.lit(None).cast("int"))
    return _clean(staged.withColumns({p: normalize.BY_PARAM[p](*v) for p, v in values.items()}))


def output_values(df: DataFrame) -> DataFrame:
    staged, values = _staged(df, lambda p: whole_number(F.col(f"_own_{p}")))
    return _clean(staged.withColumns({p: normalize.output_value(*v, p) for p, v in values.items()}))


def enforce_rules(df: DataFrame) -> DataFrame:
    """Business rules over the 12 parameters, ``brand`` and, if there, ``access_score``.

    ``violations`` lists what was changed. Rules 1 and 2 read the values that
    came in, rule 7 the corrected ones.
    """
    c = F.col
    need, months, text = c("reauth_required"), c("reauth_duration"), c("reauth_requirements")
    first = (need == "Yes") & (months == "NA")
    numeric = months.rlike(r"^\s*[+-]?\d+\s*$")
    second = (numeric | ~text.isin("NA", "N/A", "", "No")) & (need != "Yes")
    new_need = F.when(second, "Yes").otherwise(need)
    once = F.when(first, "Unspecified").otherwise(months)
    seventh = (new_need == "Yes") & (once == "NA")
    zero = lambda p: c(p).isin("0", "No")
    ql = F.lower("quantity_limits")
    fifth = ~c("quantity_limits").isin("NA", "No", "Yes", "N/A", "") & (F.contains(ql, F.lit("dosage")) | F.contains(ql, F.lit("dosing"))) & ~(F.contains(ql, F.lit("quantity limit")) | F.contains(ql, F.lit("quantity level limit")))
    says = [
        F.when(first, "R1"),
        F.when(second, "R2"),
        F.when(c("steps_through_brands") == "0", "R3"),
        F.when(c("steps_through_generic") == "0", "R4"),
        F.when(fifth, "R5"),
        F.when(c("brand") != F.upper("brand"), "R6b"),
        F.when(seventh, "R7"),
    ]
    changes = {
        "reauth_required": new_need,
        "reauth_duration": F.when(seventh, "Unspecified").otherwise(once),
        "steps_through_brands": F.when(zero("steps_through_brands"), "NA").otherwise(c("steps_through_brands")),
        "steps_through_generic": F.when(zero("steps_through_generic"), "NA").otherwise(c("steps_through_generic")),
        "quantity_limits": F.when(fifth, "NA").otherwise(c("quantity_limits")),
        "brand": F.upper("brand"),
    }
    if "access_score" in df.columns:
        own = c("access_score").cast("string")
        n = whole_number(own)
        changes["access_score"] = F.when(own.isNull() | (own == "NA") | n.isNull(), own).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), n)).cast("string"))
        says.append(F.when(own.isNotNull() & (own != "NA") & n.isNull(), "R6"))
    return df.withColumns(changes | {"violations": F.array_compact(F.array(*says))})


def light_validation(df: DataFrame) -> DataFrame:
    """The reauthorisation flag and duration from the original values, with ``corrections``.

    The flag is set when a duration or a requirement is stated; ``No`` and ``Unspecified`` are statements here.
    """
    need, months = score.text_of(F.col("reauth_required")), score.text_of(F.col("reauth_duration"))
    stated = lambda c: ~score.text_of(F.col(c)).isin("NA", "N/A", "")
    flag = (stated("reauth_duration") | stated("reauth_requirements")) & (need != "Yes")
    open_ = (need == "Yes") & months.isin("NA", "N/A", "")
    return df.withColumns({
        "reauth_required": F.when(flag, "Yes").otherwise(F.col("reauth_required")),
        "reauth_duration": F.when(open_, "Unspecified").otherwise(F.col("reauth_duration")),
        "corrections": F.array_compact(F.array(F.when(flag, "reauth_required"), F.when(open_, "reauth_duration"))),
    })


def with_facts(df: DataFrame) -> tuple[DataFrame, dict, dict]:
    """``df`` with stripped texts and what scores are made of, and those columns by name."""
    df = df.withColumns({f"_t_{p}": score.text_of(F.col(p)) for p in packs.PARAMS})
    t = {p: F.col(f"_t_{p}") for p in packs.PARAMS}
    df = df.withColumns(score.facts(t, F.col("brand")))
    return df, t, {n: F.col(n) for n in score.FACTS}


def score_records(df: DataFrame) -> DataFrame:
    """Adds access_score: one of 0, 25, 50, 75 and 100."""
    df, t, f = with_facts(df)
    df = df.withColumns(score.step_counts(t, f) | {"_held": score.restrictions(t, f), "_real": score.real_params(t)})
    b, g = F.col("_steps_b"), F.col("_steps_g")
    df = df.withColumn("_points", score.layered(b, g, F.col("_held"), f))
    final = F.when(F.col("_real") < 2, 25).when((b >= 4) & (g >= 3), 0).when(b + g >= 7, 0).when(b >= 4, 25).otherwise(score.bucket(F.col("_points")))
    return _clean(df.withColumn("access_score", final))


def results(records: DataFrame) -> DataFrame:
    """Normalised records to scored, rule-checked output rows in one narrow projection.

    The score, and what contradicts it (``findings``), are those of the record as it was before the rules.
    """
    scored = with_sanity(score_records(normalize_records(records)))
    return enforce_rules(output_values(scored).withColumn("access_score", F.col("access_score").cast("string"))).withColumn("access_score", F.col("access_score").cast("int"))


def rescore(rows: DataFrame) -> DataFrame:
    """C11: old and new score of rows read back, scored by their corrected columns."""
    cleaned = rows.withColumns({p: F.coalesce(normalize.strip(F.col(p)), F.lit("NA")) for p in packs.PARAMS}).withColumnRenamed("access_score", "old_score")
    return score_records(cleaned).withColumnRenamed("access_score", "new_score").withColumn("changed", ~F.col("old_score").eqNullSafe(F.col("new_score")))


def breakdown(rows: DataFrame) -> DataFrame:
    """A row for each component of the score."""
    rows, t, f = with_facts(rows)
    own = {p: F.col(p) for p in packs.PARAMS}
    parts = [F.struct(F.lit(n).alias("component"), F.coalesce(v, F.lit("NA")).alias("value"), pts.alias("points"), F.lit(top).alias("max")) for n, v, pts, top in score.components(own, t, f)]
    return rows.select("filename", "brand", F.explode(F.array(*parts)).alias("c")).select("filename", "brand", "c.*")


def _warned(rows: DataFrame):
    """``rows`` with facts, and the array of warnings about a score that its parameters contradict."""
    rows, t, f = with_facts(rows)
    b, g = F.coalesce(f["_b"], F.lit(0)), F.coalesce(f["_g0"], F.lit(0))
    s, total = F.col("access_score"), b + g
    none = t["step_therapy_requirements"].isin("No", "NA", "N/A", "")
    held = sum((x.cast("int") for x in (t["step_through_phototherapy"] == "Yes", t["tb_test_required"].isin("Yes", "Y"), t["quantity_limits"] == "Yes", ~t["specialist_types"].isin("NA", "N/A", "No", ""), t["reauth_required"] == "Yes")), F.lit(0))
    checks = {
        "not_a_bucket": ~s.isin(*score.BUCKETS),
        "high_with_steps": (s >= 75) & (total >= 2),
        "high_with_brands": (s > 50) & (b >= 2),
        "zero_without_steps": (s == 0) & none & (held < 3),
        "low_without_limits": (s <= 25) & (total == 0) & none & (t["reauth_required"] != "Yes") & (t["step_through_phototherapy"] != "Yes"),
        "steps_not_counted": (t["step_therapy_requirements"] == "Yes") & (total == 0),
        "steps_denied": t["step_therapy_requirements"].isin("No", "NA", "N/A") & (total > 0),
        "reauth_empty": (t["reauth_required"] == "Yes") & t["reauth_duration"].isin("NA", "N/A", "") & t["reauth_requirements"].isin("NA", "N/A", ""),
    }
    found = F.when(s.isNull(), F.array(F.lit("no_score"))).otherwise(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()])))
    return rows, found


def with_sanity(rows: DataFrame) -> DataFrame:
    """``findings``, the warnings about each row."""
    rows, found = _warned(rows)
    return _clean(rows.withColumn("findings", found))


def sanity(rows: DataFrame) -> DataFrame:
    """A row for each warning. The array is exploded where it is made: as a column, its test for emptiness would be pushed down with the whole chain of scores."""
    rows, found = _warned(rows)
    return rows.select("filename", "brand", "access_score", F.explode(found).alias("finding"))
