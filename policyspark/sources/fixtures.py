"""Policy tables derived from the star-schema tables, for queries and tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording that a field of a derived record can have, and the divisor that picks it.
WORDING = {
    "age": (1, [">=18", "18 years of age or older", "FDA labelled age", "adults", "no age limit", "N/A", "6+"]),
    "step_therapy_requirements": (2, ["NA", "no step therapy", "required", "Trial and failure of one conventional systemic therapy", "tried"]),
    "steps_through_brands": (3, ["NA", "0", "1", "two biologics", "3", "4"]),
    "steps_through_generic": (5, ["NA", "one", "2", "3 agents", "none", "one non-biologic"]),
    "step_through_phototherapy": (7, ["Yes", "No", "NA", "optional"]),
    "tb_test_required": (11, ["Y", "No", "TB screening required", "TB test not required", ""]),
    "quantity_limits": (13, ["NA", "No", "Quantity limit: 1 per 84 days", "45 mg every 12 weeks"]),
    "specialist_types": (17, ["dermatologist", "Dermatologist or Rheumatologist", "any provider", "board-certified specialist", "NA"]),
    "initial_auth_duration": (19, ["12 months", "1 year", "365 days", "52 weeks", "6", "indefinite", "not specified", "one year", "90 days", "N/A"]),
    "reauth_duration": (23, ["12", "6 months", "Unspecified", "NA", "3", "4 years"]),
    "reauth_required": (29, ["Yes", "No", "NA", "renewal is required"]),
    "reauth_requirements": (31, ["NA", "PASI 75 response", "Documented clinical improvement", "Chart notes on file"]),
}


# Sentences of derived policy pages, and the divisor that picks each; a page has one of each list.
PAGE_WORDING = {
    "head": (1, ["Products Affected: STELARA and TREMFYA. PA Criteria.", "Coverage notes of the plan.", "General criteria apply to all requests.", "Drug name: COSENTYX", "Table of contents.", "This page is left for remarks."]),
    "rule": (3, ["Plaque psoriasis of moderate severity is covered.", "Crohn disease is covered by another policy of this plan.", "The member has a body surface area of 10 percent.", "Psoriatic arthritis needs another form of this plan.", "No indication is named on this page of the plan."]),
    "brand": (7, ["STELARA may be approved for this member.", "ustekinumab is a preferred agent of this plan.", "Non-preferred products require trial of TREMFYA first.", "ENBREL is listed with other drugs of the class.", "The drugs are listed by class only.", "Preferred: COSENTYX before any other drug."]),
    "step": (11, ["The patient tried and failed methotrexate for 3 months.", "Inadequate response to one preferred biologic product is documented.", "Phototherapy or puva was ineffective for this member.", "Go to #3 of the tree for the next question.", "A quantity limit of one syringe applies.", "Nothing else is required here."]),
    "renew": (13, ["Reauthorization is granted for 12 months.", "Renewal criteria: a documented response to therapy.", "The prescriber is a dermatologist.", "A TB test is needed before the first dose.", "Patients are 18 years of age or older.", "Call the plan for help."]),
}


# What stands in each block of a derived section page, and the divisor that picks it.
SECTION_WORDING = {
    "head": (1, ["Products Affected\n{}\nPrior Authorization Criteria", "Continued from the page before.", "Products Affected: {}\nCriteria Details", "Drug names: {}\nThe list of the plan.", "Index of drugs: {} and others.", "Prior Authorization Group\n{}"]),
    "drug": (7, ["STELARA", "Tremfya", "risankizumab", "SORIATANE", "Humira", "OTEZLA"]),
    "info": (5, ["Trial and failure of two biologic drugs", "Trial and failure of one TNF blocker such as Humira", "Biologic as first-line therapy", "• Body surface area of 10 percent", "At least 2 conventional therapies", "Trial of TWO preferred products, Enbrel and Cimzia"]),
    "other": (11, ["Phototherapy or methotrexate.", "PUVA has failed after acitretin.", "Topical corticosteroids were tried", "Nothing else", "Phototherapy was ineffective."]),
    "age": (3, ["18 years of age or older", "at least 6 years of age", "Women of childbearing age", "12 years and older", "-", "adults"]),
    "who": (13, ["Dermatologist or rheumatologist", "Any prescriber", "Immunologist", "—"]),
    "cover": (17, ["Initial: 6 months, Renewal: 12 months", "Initial: 26 weeks", "Reauthorization: 24 weeks", "Plan year", "Initial: 3 months. Reauthorization: 6 months"]),
    "renew": (19, ["Renewal Criteria: documented response", "-", "Chart notes are needed", "Continued approval needs a note."]),
    "tail": (23, ["A negative tuberculin test is needed.", "A negative tuberculin test is needed. A quantity limit applies.", "A quantity limit applies.", "Nothing else."]),
}
SECTION_BRANDS = ["STELARA", "TREMFYA", "SKYRIZI", "Acitretin", "OTEZLA"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(key: str) -> list:
    """The 12 fields of a derived record, as columns of a numeric key."""
    return [F.expr(f"element_at(array({', '.join(repr(v) for v in values)}), cast(1 + ({key} div {p}) % {len(values)} as int))").alias(name) for name, (p, values) in WORDING.items()]


def brand(key: str):
    return F.concat(F.lit("Brand#"), F.expr(f"cast(1 + {key} % 25 as string)"))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows dealt out by task. The number of partitions is given, since the rows are few bytes but much work each: by size alone they would come together in one or two tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "filename", "brand")


def raw_params(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One record for each (filename, brand): that of the lowest order key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("filename"), brand("o_orderkey").alias("brand"), "o_orderkey")
    low = keyed(orders).groupBy("filename", "brand").agg(F.min("o_orderkey").alias("k"))
    return low.select("filename", "brand", (F.col("k") % 120 - 5).alias("e"), "k", (F.col("k") + shift).alias("w")).select(
        "filename", "brand", F.when(F.col("k") % 11 != 0, F.col("e").cast("int")).alias("estimated_access_score"), *picked("w"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted records: (filename, brand, pass_name, provider) and the lowest order key's fields."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("filename"), brand("o_orderkey").alias("brand"), "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, "validate").otherwise("extract").alias("pass_name"),
        F.when(F.col("o_orderkey") % 3 == 0, "groq").when(F.col("o_orderkey") % 3 == 1, "groq-optimized").otherwise("").alias("provider"))
    low = keyed(o).groupBy("filename", "brand", "pass_name", "provider").agg(F.min("o_orderkey").alias("w"))
    return low.select("filename", "brand", "pass_name", "provider", *picked("w"))


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a task's chunks; chunk_no orders them within (filename, brand)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").cast("string").alias("filename"), brand("o_orderkey").alias("brand"), "o_orderkey", "l_linenumber", (F.col("o_orderkey") + F.col("l_linenumber")).alias("w"))
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("filename", "brand").orderBy("o_orderkey", "l_linenumber")) - 1
    return keyed(rows).select("filename", "brand", no.alias("chunk_no"), F.concat(F.lit("r"), F.col("w").cast("string")).alias("reasoning"), *picked("w"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    one = docs.select((F.col("doc_id") * 2).alias("row_no"), F.col("doc_id").cast("string").alias("filename"), brand("doc_id").alias("brand"))
    two = docs.where("doc_id % 3 = 0").select((F.col("doc_id") * 2 + 1).alias("row_no"), F.col("doc_id").cast("string").alias("filename"), brand("(doc_id + 7)").alias("brand"))
    return one.unionByName(two)


def policy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each line of a document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.posexplode(F.split("text", "\n")).alias("page_num", "text"))


def worded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the pack's vocabulary, one for each order: 400 documents, whose pages follow the order key."""
    from pyspark.sql import Window

    pick = {n: F.expr(f"element_at(array({', '.join(repr(v) for v in vs)}), cast(1 + (o_orderkey div {p}) % {len(vs)} as int))") for n, (p, vs) in PAGE_WORDING.items()}
    body = F.concat(pick["head"], F.lit("\n\n"), pick["rule"], F.lit(" "), pick["brand"], F.lit("\n\n"), pick["step"], F.lit(" "), pick["renew"])
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 400).cast("string")).alias("filename"), "o_orderkey")
    placed = keys.withColumn("page_num", F.row_number().over(Window.partitionBy("filename").orderBy("o_orderkey")) - 1)  # keys are dealt out and sorted without the texts
    return placed.select("filename", "page_num", body.alias("text"))


def worded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks for each of those documents."""
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("k")).distinct()
    brands = F.array(F.lit("STELARA"), F.when(F.col("k") % 2 == 0, "TREMFYA").otherwise("COSENTYX"))
    return files.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("filename"), F.explode(brands).alias("brand"))


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents with a section for each of several drugs, one page for each order: 300 documents."""
    from pyspark.sql import Window

    pick = {n: F.expr(f"element_at(array({', '.join(repr(v) for v in vs)}), cast(1 + (o_orderkey div {p}) % {len(vs)} as int))") for n, (p, vs) in SECTION_WORDING.items()}
    head = F.replace(pick["head"], F.lit("{}"), pick["drug"])
    blocks = [(" Required Medical Information ", "info"), (". ", "other"), ("\nAge Restrictions ", "age"), ("\nPrescriber Restrictions ", "who"), ("\nCoverage Duration ", "cover"), ("\nRenewal Criteria ", "renew")]
    body = F.concat(head, F.lit("\n"), *[c for label, name in blocks for c in (F.lit(label), pick[name])], F.lit("\nEffective Date 01/01\n"), pick["tail"])
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 300).cast("string")).alias("filename"), "o_orderkey", body.alias("text"))
    return rows.select("filename", (F.row_number().over(Window.partitionBy("filename").orderBy("o_orderkey")) - 1).alias("page_num"), "text")


def section_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 300).cast("string")).alias("filename")).distinct()
    return files.withColumn("brand", F.explode(F.array(*[F.lit(b) for b in SECTION_BRANDS])))


def study_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order with more or fewer words of studies and of policies, some naming the task's drug."""
    key = F.col("o_orderkey")
    text = F.concat(F.expr("repeat('A randomized study. ', cast(o_orderkey % 9 as int))"), F.expr("repeat('The criteria hold. ', cast(o_orderkey % 4 as int))"), F.when(key % 7 == 0, "Apremilast, et al (2019)").otherwise("A cohort."))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), key.cast("string")).alias("filename"), F.when(key % 5 == 0, "STELARA").otherwise("OTEZLA").alias("brand"), text.alias("text"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of two tasks a document: its first pages under their marks, fewer or more by document, and a universal text for every third."""
    k = F.substring("filename", 2, 9).cast("int")
    kept = section_pages(spark, sf_dir).withColumn("k", k).where("page_num <= k % 45")
    said = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    page = lambda x: F.concat(F.lit("[Page "), (x["page_num"] + 1).cast("string"), F.lit("]\n"), x["text"])
    texts = kept.groupBy("filename", "k").agg(F.array_join(F.transform(said, page), "\n\n").alias("text"))
    shared = F.when(F.col("k") % 3 == 0, F.expr("repeat('All requests need a diagnosis. ', 1 + k % 7)")).otherwise("")
    return texts.select("filename", F.explode(F.array(F.lit("STELARA"), F.lit("Acitretin"))).alias("brand"), shared.alias("universal_text"), "text")


# What a stand-in for a model reads from a text: parameter, words and answer of the small and of the large one; the first words found count.
MODEL_RULES = [
    ("age", "18 years of age", ">=18", ">=18"),
    ("age", "at least 6 years", ">=6", ">=6"),
    ("steps_through_brands", "two biologic", "2", "2"),
    ("steps_through_brands", "one TNF", "1", "1"),
    ("steps_through_generic", "2 conventional", "2", "2"),
    ("step_through_phototherapy", "PUVA has failed", "Yes", "Yes"),
    ("tb_test_required", "tuberculin", "required", "Y"),
    ("quantity_limits", "quantity limit", "Yes", "Yes"),
    ("specialist_types", "Immunologist", "Immunologist", "Immunologist"),
    ("initial_auth_duration", "Initial: 3 months", "3 months", "3"),
    ("initial_auth_duration", "Initial: 6 months", "6 months", "6"),
    ("reauth_duration", "Renewal: 12 months", "12 months", "12"),
    ("reauth_required", "Chart notes", "Yes", "Yes"),
]
#: Words with which the small one doesn't answer, omits a required parameter; with which the large one's answer can't be read, and where it omits it if it is to confirm.
SMALL_FAILS, SMALL_OMITS, LARGE_UNREADABLE, LARGE_OMITS = "Index of drugs", "Biologic as first-line", "—", "PUVA has failed"
#: Texts with these words and more than so many characters are too large for the large one.
TOO_LARGE_WORDS, TOO_LARGE_CHARS = "Plan year", 900


def _answer(text: str, large: bool, omit: bool) -> str:
    out = {p: "NA" for p in WORDING}
    for param, words, small_value, large_value in reversed(MODEL_RULES):
        if words in text:
            out[param] = large_value if large else small_value
    out["step_therapy_requirements"] = f"{len(text)} characters of policy text"
    if omit:
        del out["steps_through_brands"]
    return json.dumps(out | {"reasoning": f"read {len(text)}"})


def small_model(prompts: list[str]) -> list[str | None]:
    """Stands in for a small model: reads the text behind ``Policy text``."""
    texts = [p.split("Policy text:\n", 1)[1].split("\n\nPOLICY TEXT:\n")[0] for p in prompts]
    return [None if SMALL_FAILS in t else _answer(t, False, SMALL_OMITS in t) for t in texts]


def large_model(prompts: list[str]) -> list[str | None]:
    """Stands in for a large model: reads the text behind ``POLICY TEXT``."""
    from policyspark.operators.infer import TOO_LARGE

    out: list[str | None] = []
    for p in prompts:
        t = p.split("POLICY TEXT:\n", 1)[1]
        confirms = "STEP REQUIREMENTS" in p
        out.append(TOO_LARGE if TOO_LARGE_WORDS in t and len(t) > TOO_LARGE_CHARS else "not readable" if LARGE_UNREADABLE in t else _answer(t, True, confirms and LARGE_OMITS in t))
    return out
