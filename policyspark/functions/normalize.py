"""Normalisers of extracted values (N1-N10) and of output values (V1-V8).

All are Column -> Column and stay within generated code. They take the stripped
value, its lower case and its first number, which the caller computes once in
projections of their own: used in many branches of a CASE, an expression would
otherwise be compiled anew for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark import packs


def strip(c: Column) -> Column:
    """Trim white space of every kind, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_in(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def is_na(low: Column) -> Column:
    return low.isin(packs.NA_FORMS)


def first_number(low: Column) -> Column:
    """Leading digits, or the first number word found anywhere, else null."""
    digits = F.regexp_extract(low, r"^(\d+)", 1)
    words = F.when(F.lit(False), F.lit(0))
    for word, n in packs.NUMBER_WORDS.items():
        words = words.when(F.contains(low, F.lit(word)), F.lit(n))
    return F.when(digits != "", digits.try_cast("int")).otherwise(words)


def yes_no(own: Column, low: Column, n: Column) -> Column:
    return (
        F.when(is_na(low), "NA")
        .when(low.isin(packs.NO_FORMS), "No")
        .when(low.isin(packs.YES_FORMS) | any_in(low, packs.YES_PHRASES), "Yes")
        .when(any_in(low, packs.NO_PHRASES), "No")
        .when(F.length(own) <= 5, own)
        .otherwise("Yes")
    )


def step_count(own: Column, low: Column, n: Column) -> Column:
    return F.when(is_na(low), "NA").otherwise(F.coalesce(n.cast("string"), F.lit("NA")))


def duration(own: Column, low: Column, n: Column) -> Column:
    """Whole months as text, or NA."""
    at_least_one = lambda k: F.greatest(F.lit(1), F.floor(n / k)).cast("int")
    months = (
        F.when(F.contains(low, F.lit("year")), n * 12)
        .when(F.contains(low, F.lit("week")), at_least_one(4))
        .when(F.contains(low, F.lit("day")), at_least_one(30))
        .when(n <= 36, n)
        .when(n <= 400, at_least_one(30))
        .otherwise(n)
    )
    return F.when(is_na(low) | any_in(low, packs.OPEN_ENDED) | n.isNull(), "NA").otherwise(months.cast("string"))


def age(own: Column, low: Column, n: Column) -> Column:
    result = F.when(is_na(low), "NA").when(any_in(low, packs.AGELESS), "No")
    for pattern in packs.AGE_PATTERNS:
        result = result.when(low.rlike(pattern), F.concat(F.lit(">="), F.regexp_extract(low, pattern, 1)))
    return result.when(F.contains(low, F.lit("adult")) & ~F.contains(low, F.lit("pediatric")), ">=18").when(own.rlike(r"^\d+$"), F.concat(F.lit(">="), own)).otherwise(own)


def specialist(own: Column, low: Column, n: Column) -> Column:
    known = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s)), F.lit(s.capitalize())) for s in packs.SPECIALISTS]))
    return (
        F.when(is_na(low) | any_in(low, packs.ANY_SPECIALIST), "NA")
        .when(F.size(known) > 0, F.array_join(known, ", "))
        .when(any_in(low, ["specialist", "board-certified"]), "Specialist")
        .when(F.length(own) <= 30, F.initcap(own))
        .otherwise(own)
    )


def step_therapy(own: Column, low: Column, n: Column) -> Column:
    return F.when(is_na(low), "NA").when(low.isin(packs.STEP_NO), "No").when(low.isin(packs.STEP_YES), "Yes").when(F.length(own) > 20, own).when(any_in(low, packs.STEP_WORDS), "Yes").otherwise(own)


def quantity(own: Column, low: Column, n: Column) -> Column:
    dosage, limit = any_in(low, packs.DOSAGE_WORDS), any_in(low, packs.LIMIT_WORDS)
    return (
        F.when(is_na(low), "NA")
        .when(low.isin(packs.LIMIT_NO), "No")
        .when(low.isin("yes", "true"), "Yes")
        .when(dosage & ~limit, "NA")
        .when(limit, "Yes")
        .when(F.length(own) <= 5, yes_no(own, low, n))
        .when(F.length(own) > 20, "Yes")
        .otherwise(own)
    )


def free_text(own: Column, low: Column, n: Column) -> Column:
    return F.when(is_na(low), "NA").otherwise(own)


#: The normaliser of each parameter.
BY_PARAM = {
    "age": age,
    "step_therapy_requirements": step_therapy,
    "steps_through_brands": step_count,
    "steps_through_generic": step_count,
    "step_through_phototherapy": yes_no,
    "tb_test_required": yes_no,
    "quantity_limits": quantity,
    "specialist_types": specialist,
    "initial_auth_duration": duration,
    "reauth_duration": duration,
    "reauth_required": yes_no,
    "reauth_requirements": free_text,
}


def output_value(own: Column, low: Column, n: Column, param: str) -> Column:
    """A parameter's value in the vocabulary of the final table; ``n`` is its whole number."""
    first = F.when(own.isNull() | low.isin("", "none"), "NA")
    if param == "tb_test_required":
        rest = F.when(low.isin("yes", "y", "true", "1", "required"), "Y").when(low.isin("no", "n", "false", "0", "not required"), "No").when(low.isin("na", "n/a", "not applicable", "not mentioned"), "NA")
    elif param == "reauth_required":
        rest = F.when(low.isin("yes", "y", "true", "1"), "Yes").when(low.isin("no", "n", "false", "0"), "No").when(low.isin("na", "n/a", "not applicable"), "NA")
    elif param == "step_through_phototherapy":
        rest = F.when(low.isin("na", "n/a", "not applicable", "not mentioned"), "N/A").when(low.isin("yes", "y", "true", "1", "required"), "Yes").when(low.isin("no", "n", "false", "0", "not required"), "No")
    elif param == "quantity_limits":
        rest = F.when(low.isin("na", "n/a", "not applicable", "not mentioned", "unspecified", "not specified", "none"), "NA").when(low.isin("no", "n", "false", "0", "no quantity limit", "no quantity limits"), "No").when(low.isin("yes", "y", "true", "1"), "Yes")
    elif param in ("steps_through_brands", "steps_through_generic"):
        rest = F.when(low.isin("na", "n/a", "no", "none", "0", "not applicable", "not mentioned") | (n == 0), "NA").when(n.isNotNull(), n.cast("string"))
    elif param in ("initial_auth_duration", "reauth_duration"):
        run = F.regexp_extract(own, r"(\d+)", 1)
        rest = F.when(low.isin("na", "n/a", "not mentioned"), "NA").when(low.isin("unspecified", "not specified", "unknown"), "Unspecified").when(run != "", run)
    elif param == "specialist_types":
        rest = F.when(low.isin("na", "n/a", "no", "none", "not specified", "not mentioned"), "NA")
    elif param == "age":
        rest = F.when(low.isin("none", "not specified", "na", "n/a", "not mentioned"), "No").when(F.contains(low, F.lit("fda")), "FDA labelled age")
    else:
        return first.otherwise(own)
    return first.otherwise(F.coalesce(rest, own))


def whole_number(c: Column) -> Column:
    """int(float(text)), or null where that fails."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), strip(c).try_cast("double").cast("bigint").cast("int"))
