"""Rule-based parameter extraction from a policy's section text (X1-X12) and step analysis.

Null means that a rule found nothing, which is not the same as 'NA'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions import text as T
from policyspark.functions.normalize import any_in, strip

# Labels that end a block, in their order on the page.
LABELS = [r"Age\s+Restrictions", r"Prescriber\s+Restrictions", r"Coverage\s+Duration", r"Renewal\s+Criteria", r"Effective\s+Date", r"P&T\s+Approval\s+Date", r"P&T\s+Revision\s+Date"]
AGE_RULES = [r"(\d{1,2})\s*years?\s*of\s*age\s*or\s*older", r"at\s*least\s*(\d{1,2})\s*years?\s*of\s*age", r"(\d{1,2})\s*years?\s*and\s*older", r"aged?\s*(\d{1,2})\s*or\s*older", r"must\s*be\s*(?:at\s*least\s*)?(\d{1,2})\s*years?"]
GENERIC_TERMS = ["topical corticosteroids", "corticosteroids", "vitamin d analogs", "vitamin d analogues", "tazorac", "tazarotene", "topical tacrolimus", "tacrolimus", "elidel", "pimecrolimus", "methotrexate", "cyclosporine", "acitretin", "conventional therapies", "topical therapies", "non-biologic"]
SPECIALISTS = {"dermatologist": "Dermatologist", "rheumatologist": "Rheumatologist", "gastroenterologist": "Gastroenterologist", "immunologist": "Immunologist", "infectious disease specialist": "Infectious Disease Specialist"}
# Step patterns in order, with the kind of step they name and the group of the count (0: no count is stated).
STEP_PATTERNS = [
    (r"(?i)(?:trial|failure|failed|inadequate\s+response)\s+(?:of|to)\s+(ONE|TWO|THREE|FOUR|FIVE|\d+)\s+(?:preferred\s+)?(?:product|agent|biologic|medication)s?", "branded", 1),
    (r"(?i)(?:at\s+least\s+|minimum\s+of\s+)?(one|two|three|four|five|\d+)\s*(?:\(\d+\)\s*)?preferred\s+biologic\s+(?:product|agent|medication)s?", "branded", 1),
    (r"(?i)(?:at\s+least\s+|minimum\s+of\s+)?(one|two|three|four|five|\d+)\s*(?:\(\d+\)\s*)?(?:systemic|conventional|non-biologic)\s+(?:therap(?:y|ies)|agent|medication|DMARD)s?", "generic", 1),
    (r"(?i)(ONE|TWO|THREE|\d+)\s+(?:formulary\s+)?conventional\s+prerequisite\s+agent", "generic", 1),
    (r"(?i)previously\s+received\s+(?:a|one)\s+(?:biologic|targeted\s+(?:immune|synthetic)\s+(?:drug|modulator))", "branded_1", 0),
    (r"(?i)unable\s+to\s+take\s+(ONE|TWO|THREE|FOUR|FIVE|\d+)\s+preferred\s+products?", "branded", 1),
    (r"(?i)(?:trial|failure)\s+(?:of|and\s+failure\s+(?:of|to))\s+(?:at\s+least\s+)?(one|two|three|\d+)\s*(?:\(\d+\)\s*)?(?:of\s+the\s+following\s+)?(?:topical|conventional)\s+therap(?:y|ies)", "generic", 1),
    (r"(?i)(?:trial|failure|inadequate)\s+(?:of|to|and\s+failure\s+(?:of|to))\s+.*?(?:methotrexate|cyclosporine|acitretin)", "generic_mention", 0),
    (r"(?i)(?:trial\s+and\s+failure|trial|failure|intolerance)\s*(?:,\s*(?:contraindication|intolerance)\s*)*(?:,?\s*or\s+(?:contraindication|intolerance)\s+)?to\s+(?:one|any)\s+of\s+the\s+following\s+(?:topical\s+)?(?:therap(?:y|ies)|medication|agent)", "generic_mention", 0),
    (r"(?i)(?:inadequate\s+response|therapeutic\s+failure|intolerance)\s+to\s+(?:at\s+least\s+)?(one|two|three|\d+)\s*(?:\(\d+\)\s*)?(?:of\s+the\s+following\s+)?(?:systemic|topical|conventional)\s+(?:therap(?:y|ies)|agent|medication)", "generic", 1),
    (r"(?i)(?:trial|failure|require)\s+(?:of|and\s+failure\s+(?:of|to))?\s*(ONE|TWO|THREE|FOUR|FIVE|\d+)\s+preferred\s+(?:anti-TNF|anti-tumor|agent|product)", "branded", 1),
    (r"(?i)require\s+(?:trial\s+and\s+failure\s+of\s+)?ALL\s+preferred\s+(?:agent|product)s?", "branded_all", 0),
    (r"(?i)previously\s+received\s+a\s+(?:biologic|targeted\s+synthetic\s+drug)", "branded_1", 0),
]
# What names one or two branded steps.
TWO_BRANDS = r"trial\s+and\s+failure.*?\b(two|2)\b.*?(biologic|tnf|humira|enbrel|stelara|skyrizi|tremfya|cimzia)"
ONE_BRAND = r"trial\s+and\s+failure.*?\b(one|1)\b.*?(biologic|tnf|humira|enbrel|stelara|skyrizi|tremfya|cimzia)"
PHOTO = ["phototherapy", "puva", "uvb", "psoralen", "light therapy"]


def blocks(section: Column) -> dict[str, Column]:
    return {
        "info": T.block_between(section, r"Required\s+Medical\s+Information", LABELS),
        "age": T.block_between(section, LABELS[0], LABELS[1:]),
        "prescriber": T.block_between(section, LABELS[1], LABELS[2:]),
        "coverage": T.block_between(section, LABELS[2], LABELS[3:]),
        "renewal": T.block_between(section, LABELS[3], LABELS[4:]),
    }


def parameters(section: Column, b: dict[str, Column]) -> dict[str, Column]:
    """The 12 parameters, from the section and its blocks (columns computed beforehand)."""
    low = F.lower(section)
    info = F.lower(b["info"])
    age_text = F.lower(T.compact(b["age"]))
    age = F.when(b["age"].isNull(), None)
    for p in AGE_RULES:
        age = age.when(age_text.rlike(p), F.concat(F.lit(">="), F.regexp_extract(age_text, p, 1)))
    age = age.when(any_in(age_text, ["childbearing", "able to bear children", "pregnancy"]), None).otherwise(T.compact(b["age"]))
    lines = "(?d)"  # only a line feed ends a line
    branded = F.when(info.rlike(lines + TWO_BRANDS), 2).when(info.rlike(lines + ONE_BRAND), 1).when(F.contains(info, F.lit("biologic as first-line")), 0)
    generic = F.when(info.rlike(r"at\s+least\s+(?:2|two)\s+conventional\s+therap|\b(?:2|two)\s+(?:topical|generic|non-biologic|conventional)"), 2).when(any_in(info, GENERIC_TERMS), 1)
    photo = F.when(any_in(info, ["phototherapy", "puva", "uvb"]), F.when(any_in(info, ["one of the following", "conventional therapies", "or "]), "No").otherwise("Yes"))
    who = F.array_compact(F.array(*[F.when(F.contains(F.lower(b["prescriber"]), F.lit(k)), F.lit(v)) for k, v in SPECIALISTS.items()]))
    cover = F.coalesce(b["coverage"], section)

    def months(label: str) -> Column:
        m, w = (F.regexp_extract(cover, rf"(?i)\b{label}\s*:\s*(\d+)\s*{u}s?", 1).try_cast("int") for u in ("month", "week"))
        return m, F.rint(w / F.lit(4.0)).cast("int")

    initial, renewal = F.coalesce(*months("initial")), F.coalesce(months("renewal")[0], months("reauthorization")[0], months("renewal")[1])
    again = T.compact(b["renewal"])
    return {
        "age": age,
        "step_therapy_requirements": F.nullif(T.compact(F.replace(T.compact(b["info"]), F.lit("• "), F.lit(""))), F.lit("")),
        "steps_through_brands": branded.cast("string"),
        "steps_through_generic": generic.cast("string"),
        "step_through_phototherapy": photo,
        "tb_test_required": F.when(low.rlike(r"\bnegative\s+tuberculin\b|\btb\s+test\b|\btuberculosis\b|\blatent\s+tb\b"), "Y"),
        "quantity_limits": F.when(F.contains(low, F.lit("quantity limit")), "Yes"),
        "specialist_types": F.when(F.size(who) > 0, F.array_join(who, ", ")),
        "initial_auth_duration": initial.cast("string"),
        "reauth_duration": renewal.cast("string"),
        "reauth_required": F.when(renewal.isNotNull() | b["renewal"].isNotNull(), "Yes"),
        "reauth_requirements": F.nullif(strip(F.regexp_replace(again, r"(?i)^Renewal Criteria:\s*", "")), F.lit("")),
    }


def drug_classes() -> dict[str, str]:
    """every drug name of at least four letters and the class that its steps count for.

    Biosimilars and their generic names count as generic; generic names of
    originator brands as branded, also where they are in the list of generics.
    """
    found = {d: "branded" for d in packs.BIOLOGICS} | {d: "generic" for d in [*packs.BIOSIMILARS, *packs.GENERICS]}
    found |= {g: "generic" if b.lower() in packs.BIOSIMILARS else "branded" for b, g in packs.BRAND_GENERIC.items()}
    return {d: k for d, k in found.items() if len(d) >= 4}


def requirements(text: Column) -> Column:
    """The first match of each step pattern, with its count, kind, source and connector.

    The source reaches from 50 characters before the match to 100 after it, and is
    [start, end) of the text; the connector is sought from 300 before to 300
    after. "ALL" counts as two.
    """

    def one(pattern: str, kind: str, group: int) -> Column:
        pattern = "(?d)" + pattern
        at, n = F.regexp_instr(text, F.lit(pattern)), F.length(F.regexp_extract(text, pattern, 0))
        count = T.count_word(F.regexp_extract(text, pattern, group)) if group else F.lit(2 if kind == "branded_all" else 1)
        start, end = F.greatest(at - 51, F.lit(0)), F.least(at - 1 + n + 100, F.length(text))
        around = F.substring(text, F.greatest(at - 300, F.lit(1)), F.least(at - 1, F.lit(300)) + n + 300)
        found = F.struct(count.alias("count"), F.lit(kind.split("_")[0]).alias("drug_type"), T.connector(around).alias("connector"), F.substring(text, start + 1, end - start).alias("source_text"), start.alias("start"), end.alias("end"))
        return F.when(at > 0, found)

    return F.array_compact(F.array(*[one(*p) for p in STEP_PATTERNS]))


def laid_out(section: Column) -> Column:
    """S13f: whether the first 500 characters have two of the marks of the labelled layout."""
    head = F.lower(F.substring(section, 1, 500))
    return sum((F.contains(head, F.lit(m)).cast("int") for m in packs.LAYOUT_MARKS), F.lit(0)) >= 2


def plain_value(param: str, c: Column) -> Column:
    """S13g: whether a simple parameter's value has a form that needs no second look."""
    own = strip(F.coalesce(c, F.lit("")))
    allowed = {"tb_test_required": ["Y", "No", "NA"], "reauth_required": ["Yes", "No", "NA"]}
    if param in allowed:
        return own.isin(allowed[param])
    if param in ("initial_auth_duration", "reauth_duration"):
        return own.rlike(r"^[0-9]+$") | own.isin("NA", "Unspecified", "No")
    return own != ""


def phototherapy(text: Column) -> Column:
    """P5: struct of mandatory (null if never named) and in_or; once in an OR, later sentences stay so."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: any_in(F.lower(s), PHOTO))
    named = r"(?:phototherapy|puva|uvb)"
    state = F.struct(F.lit(False).alias("m"), F.lit(False).alias("o"))

    def step(s, p):
        low = F.lower(p)
        either = s["o"] | low.rlike(rf"{named}.*?\bor\b|\bor\b.*?{named}") | any_in(low, ["one of the following", "any of the following", "either"])
        alone = low.rlike(rf"{named}\s+(?:has been|was)\s+(?:ineffective|inadequate|unsuccessful)|(?:trial|failure)\s+(?:of|and)\s+{named}")
        return F.struct((s["m"] | (~either & alone)).alias("m"), either.alias("o"))

    done = F.aggregate(parts, state, step)
    return F.struct(F.when(any_in(F.lower(text), PHOTO), done["m"] & ~done["o"]).alias("mandatory"), done["o"].alias("in_or"))


def combine(reqs: Column, n_mentions: Column, universal_chars: Column | None = None) -> Column:
    """ANDed counts add up; of ORed paths the least counts, generic before branded.

    The struct has both counts, the confidence and the reasoning, a line for each thing that counted.
    """
    of = lambda kind, link: F.transform(F.filter(reqs, lambda r: (r["drug_type"] == kind) & (r["connector"] == link)), lambda r: r["count"])
    total = lambda kind: F.aggregate(of(kind, "AND"), F.lit(0), lambda a, n: a + n)
    generics, brands = of("generic", "OR"), of("branded", "OR")
    shown = lambda n: F.when(n > 0, n.cast("string")).otherwise("NA")
    listed = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    g, b = F.array_min(generics), F.array_min(brands)
    generic = total("generic") + F.coalesce(g, F.lit(0))
    branded = total("branded") + F.when(g.isNull(), F.coalesce(b, F.lit(0))).otherwise(0)
    level = F.when(F.size(reqs) >= 2, "high").when((F.size(reqs) == 1) | (n_mentions > 0), "medium").otherwise("low")
    least = (
        F.when(g.isNotNull() & b.isNotNull(), F.concat(F.lit("least of OR: brands "), listed(brands), F.lit(", generics "), listed(generics), F.lit(": "), g.cast("string"), F.lit(" generic")))
        .when(b.isNotNull(), F.concat(F.lit("least of OR: "), b.cast("string"), F.lit(" branded of "), listed(brands)))
        .when(g.isNotNull(), F.concat(F.lit("least of OR: "), g.cast("string"), F.lit(" generic of "), listed(generics)))
    )
    none = F.when((F.size(reqs) == 0) & (n_mentions > 0), F.concat(F.lit("no pattern, drug mentions: "), n_mentions.cast("string"))).when(F.size(reqs) == 0, F.lit("no pattern, no drug mention"))
    steps = F.transform(reqs, lambda r: F.concat(r["connector"], F.lit(": "), r["count"].cast("string"), F.lit(" "), r["drug_type"], F.lit(" from "), F.substring(r["source_text"], 1, 80)))
    shared = F.when(universal_chars > 0, F.concat(F.lit("universal text apart: "), universal_chars.cast("string"))) if universal_chars is not None else F.lit(None).cast("string")
    why = F.array_join(F.array_compact(F.concat(F.array(shared), steps, F.array(least, none))), " | ")
    return F.struct(shown(branded).alias("branded_steps"), shown(generic).alias("generic_steps"), level.alias("confidence"), why.alias("reasoning"))
