"""Access score: component points (G1-G12), layered score (G15) and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions.normalize import strip, whole_number

OFFSET = 25
BUCKETS = (0, 25, 50, 75, 100)


def text_of(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def numeric(text: Column) -> Column:
    return F.when(~text.isin("NA", "N/A", "No", "Unspecified", ""), whole_number(text))


def age_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def label_age(brand: Column) -> Column:
    """The label's least age; 18 where the brand has none or is unknown."""
    found = F.when(F.lit(False), F.lit(""))
    for b, a in packs.LABEL_AGE.items():
        found = found.when(brand == b, a)
    return F.coalesce(F.regexp_extract(F.coalesce(found, F.lit(">=18")), r"(\d+)", 1).try_cast("int"), F.lit(18))


def by_steps(text: Column, number: Column, points: tuple[int, int, int, int]) -> Column:
    n = F.coalesce(number, F.lit(0))
    return F.when(text.isin("NA", "N/A", "No", "", "0") | (n <= 0), points[0]).when(n == 1, points[1]).when(n == 2, points[2]).otherwise(points[3])


def age_points(s: Column, brand: Column) -> Column:
    n, label = age_number(s), label_age(brand)
    return F.when(s.isin("No", ""), 10).when(n.isNull(), 8).when(n == label, 8).when(n > label, 3).otherwise(10)


def reauth_text_points(s: Column) -> Column:
    low = F.lower(s)
    strict, lenient = "|".join(packs.STRICT_REAUTH), "|".join(packs.LENIENT_REAUTH)
    return F.when(s.isin("NA", "N/A", "No", "", "Unspecified"), 10).when(low.rlike(f"(?d){strict}"), 3).when(low.rlike(f"(?d){lenient}"), 7).otherwise(5)


#: Names of the columns that :func:`facts` computes.
FACTS = ("_b", "_g0", "_months", "_again", "_age", "_words", "_need", "_photo", "_tb", "_ql", "_who")


def facts(t: dict[str, Column], brand: Column) -> dict[str, Column]:
    """What scores are made of, from stripped texts ``t``."""
    return {
        "_b": numeric(t["steps_through_brands"]),
        "_g0": numeric(t["steps_through_generic"]),
        "_months": numeric(t["initial_auth_duration"]),
        "_again": numeric(t["reauth_duration"]),
        "_age": age_points(t["age"], brand),
        "_words": reauth_text_points(t["reauth_requirements"]),
        "_need": t["reauth_required"] == "Yes",
        "_photo": t["step_through_phototherapy"] == "Yes",
        "_tb": t["tb_test_required"].isin("Yes", "Y"),
        "_ql": t["quantity_limits"] == "Yes",
        "_who": ~t["specialist_types"].isin("NA", "N/A", "No", ""),
    }


def components(p: dict[str, Column], t: dict[str, Column], f: dict[str, Column]) -> list[tuple[str, Column, Column, int]]:
    """Name, value, points and maximum of the ten components."""
    m = f["_months"]
    return [
        ("Steps Brands", p["steps_through_brands"], by_steps(t["steps_through_brands"], f["_b"], (20, 12, 6, 0)), 20),
        ("Steps Generic", p["steps_through_generic"], by_steps(t["steps_through_generic"], f["_g0"], (15, 10, 5, 0)), 15),
        ("Phototherapy", p["step_through_phototherapy"], F.when(f["_photo"], 0).otherwise(5), 5),
        ("TB Test", p["tb_test_required"], F.when(f["_tb"], 0).otherwise(5), 5),
        ("Age", p["age"], f["_age"], 10),
        ("Init Auth Duration", p["initial_auth_duration"], F.when(m.isNull(), 8).when(m >= 12, 15).when(m >= 6, 10).when(m >= 3, 5).otherwise(3), 15),
        ("Reauth Required", p["reauth_required"], F.when(~f["_need"], 10).when(f["_again"].isNotNull(), 5).otherwise(3), 10),
        ("Quantity Limits", p["quantity_limits"], F.when(t["quantity_limits"].isin("No", "NA", "N/A", ""), 5).otherwise(0), 5),
        ("Specialist", p["specialist_types"], F.when(f["_who"], 0).otherwise(5), 5),
        ("Reauth Reqs", p["reauth_requirements"], f["_words"], 10),
    ]


def restrictions(t: dict[str, Column], f: dict[str, Column]) -> Column:
    flags = [f["_photo"], f["_tb"], f["_ql"], f["_who"], f["_need"], ~t["age"].isin("No", "", "NA"), F.coalesce(f["_months"] < 6, F.lit(False))]
    return sum((x.cast("int") for x in flags), F.lit(0))


def real_params(t: dict[str, Column]) -> Column:
    return sum(((~t[k].isin("NA", "N/A", "", "None", "No")).cast("int") for k in packs.PARAMS), F.lit(0))


def step_counts(t: dict[str, Column], f: dict[str, Column]) -> dict[str, Column]:
    """Branded steps, and generic ones, of which a told requirement without counts has one."""
    text = t["step_therapy_requirements"]
    told = ~text.isin("No", "NA", "N/A", "", "None", "Yes") & (F.length(text) > 20)
    b, g = F.coalesce(f["_b"], F.lit(0)), F.coalesce(f["_g0"], F.lit(0))
    return {"_steps_b": b, "_steps_g": F.when(told & (b + g == 0), 1).otherwise(g)}


def layered(b: Column, g: Column, held: Column, f: dict[str, Column]) -> Column:
    """Points before the offset: a base by steps, then what each restriction costs."""
    total, m, again, words = b + g, f["_months"], f["_again"], f["_words"]
    base = (
        F.when(total <= 0, 90.0)
        .when(total == 1, F.when(b == 0, 50.0).otherwise(40.0))
        .when(total == 2, F.when(b <= 1, 30.0).otherwise(20.0))
        .when(total == 3, 15.0)
        .when(total == 4, 10.0)
        .otherwise(5.0)
    )
    start = F.when(m.isNull(), F.when(f["_need"], -2).otherwise(0)).when(m >= 12, 5).when(m >= 6, 2).when(m >= 3, 0).otherwise(-5)
    renew = F.when(~f["_need"], 0).when(again >= 12, -2).when(again <= 3, -8).otherwise(-5)
    wording = F.when(words <= 3, -5).when(words <= 5, -3).otherwise(0)
    other = sum((F.when(x, cost).otherwise(0) for x, cost in ((f["_age"] <= 3, -5), (f["_photo"], -8), (f["_tb"], -3), (f["_ql"], -3), (f["_who"], -5))), F.lit(0))
    factor = F.when(held >= 6, F.lit(0.60)).when(held == 5, F.lit(0.70)).when(held == 4, F.lit(0.80)).otherwise(F.lit(1.0))
    points = (base + start + renew + wording + other) * factor
    return F.when(b >= 2, F.least(points, F.lit(50.0))).otherwise(points)


def bucket(points: Column) -> Column:
    """Points with the offset, rounded half to even, as the nearest bucket."""
    n = F.rint(points + OFFSET)
    return F.when(n <= 12, 0).when(n <= 37, 25).when(n <= 62, 50).when(n <= 87, 75).otherwise(100)


def confidence(estimate: Column, score: Column) -> Column:
    """Struct of llm_estimate, deterministic, diff and level."""
    held = F.when(estimate.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), estimate.cast("int"))))
    diff = F.abs(held - score)
    level = F.when(held.isNull() | score.isNull(), "N/A").when(diff <= 15, "High").when(diff <= 30, "Medium").otherwise("Low")
    return F.struct(held.alias("llm_estimate"), score.alias("deterministic"), diff.alias("diff"), level.alias("level"))
