"""Texts that repeat are looked at once; the rows are those of a look at every page."""

import pytest
from pyspark.sql import functions as F

from policyspark.functions import text as T
from policyspark.operators import context, infer, repeats, report, tiers
from policyspark.operators.context import TASK

HEAD = "Products Affected: STELARA and TREMFYA. PA Criteria.\n\n"
GOOD = "Plaque psoriasis is covered. STELARA may be approved after trial of methotrexate.\n\nPhototherapy or puva was ineffective for this member. Reauthorization is granted for 12 months."
TEXTS = [HEAD + GOOD, "Table of contents.", None, "", " \n 12 \n", GOOD, "Non-preferred products require trial of TREMFYA first.\n\nCrohn disease – another policy.", "General criteria apply to all requests.\n\n\n\nPage 3 of 9\nPreferred:  COSENTYX - any drug of the class.", "Go to #3. ENBREL is a preferred agent of this plan. Inadequate response to one preferred biologic product of the plan.\n\n7"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tables(spark):
    """A short document, one of 60 pages that name several drugs, and one that names none."""
    pages = [(f, n, TEXTS[(n * k) % len(TEXTS)]) for f, k, m in (("a", 1, 9), ("b", 2, 60), ("d", 4, 30)) for n in range(m)] + [("c", n, "Nothing is said here, but the disease psoriasis.") for n in range(12)]
    tasks = [("a", "STELARA"), ("b", "STELARA"), ("b", "TREMFYA"), ("b", "TREMFYA"), ("c", "COSENTYX"), ("d", None), ("d", "Unknown")]
    return spark.createDataFrame(tasks, "filename string, brand string"), spark.createDataFrame(pages, "filename string, page_num int, text string")


def both_ways(monkeypatch, rows_of):
    """The rows with few texts and with many, and the plan with few."""
    df = rows_of()
    few = sorted(map(str, df.collect()))
    monkeypatch.setattr(repeats, "FEW", -1)
    many = sorted(map(str, rows_of().select(*df.columns).collect()))
    monkeypatch.undo()
    return few, many, plan_of(df)


def test_paragraphs_of_a_text_once(monkeypatch, tables):
    few, many, plan = both_ways(monkeypatch, lambda: tiers.paragraph_rows(*tables))
    assert few == many and few and "regexp" not in plan and "RLIKE" not in plan


def test_section_of_a_text_once(monkeypatch, tables):
    few, many, plan = both_ways(monkeypatch, lambda: tiers.section_rows(*tables))
    assert few == many and few and "regexp" not in plan and "RLIKE" not in plan and "Window" not in plan


def test_snippets_of_a_text_once(monkeypatch, tables):
    tasks, pages = tables
    few, many, plan = both_ways(monkeypatch, lambda: tiers.snippet_rows(tasks, pages, tiers.paragraph_rows(tasks, pages)))
    assert few == many and few and "regexp" not in plan and "RLIKE" not in plan


def test_steps_of_a_text_once(monkeypatch, tables):
    sections = tables[1].select("filename", F.col("page_num").cast("string").alias("brand"), "text")
    few, many, plan = both_ways(monkeypatch, lambda: context.step_analysis(sections))
    assert few == many and len(few) == 111 and "regexp" not in plan and "RLIKE" not in plan


def test_analysis_of_a_text_once(monkeypatch, tables):
    sections = tables[1].select(F.col("page_num").alias("n"), "filename", F.col("page_num").cast("string").alias("brand"), "text")
    few, many, plan = both_ways(monkeypatch, lambda: infer.with_analysis(sections, TASK))
    assert few == many and len(few) == 111 and "regexp" not in plan and "RLIKE" not in plan


def rebuilt(pieces, rule):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", pieces.alias("x")))), lambda x: x["x"]), rule)


@pytest.mark.parametrize("level", ["paragraph", "sentence"])
def test_package_is_cleaned_as_a_whole(monkeypatch, tables, level):
    few, many, plan = both_ways(monkeypatch, lambda: tiers.context_package(*tables, level).withColumn("n", F.length("full_text")))
    assert few == many and len(few) == 5 and "library" in plan
    rows = tiers.context_package(*tables, level).where("section_text <> ''")
    if level == "sentence":
        rows = rows.withColumn("full_text", F.regexp_extract("full_text", r"(?s)^(.*?)(\n\n---\n\n\[PARAMETER.*)?$", 1))
    whole = T.clean(F.concat_ws("\n\n---\n\n", F.nullif("universal_text", F.lit("")), "section_text"))
    for r in rows.select("full_text", whole.alias("want")).collect():
        assert r["full_text"] == r["want"] != ""


def test_page_package_is_cleaned_as_a_whole(monkeypatch, tables):
    few, many, plan = both_ways(monkeypatch, lambda: tiers.context_package(*tables, "page"))
    assert few == many and "library" in plan
    said = F.concat(F.lit("[Page "), (F.col("page_num") + 1).cast("string"), F.lit(" | Tag: "), F.col("tag"), F.lit("]\n"), T.strip(F.col("text")))
    want = tiers.page_tags(*tables).where("included").groupBy(*TASK).agg(T.clean(rebuilt(said, "\n\n---\n\n")).alias("want"))
    rows = tiers.context_package(*tables, "page").join(want, TASK).collect()
    assert len(rows) == 5 and all(r["full_text"] == r["want"] for r in rows)


def test_totals_need_no_texts_of_sections(tables):
    plan = plan_of(report.dry_run_by_type(tiers.context_package(*tables, "paragraph")))
    assert "Last Update" not in plan and "collect_list" not in plan


def test_pieces_are_cleaned_as_in_the_whole(spark):
    rows = [(" a  b ",), ("12",), ("x\n\n 7 \n\n",), ("Page 3\nof 4 x",), ("Last Update: y",), ("w - v\n \n \n\nz -",), ("Page 1 of 2\n\n\n3",), (" q\u0085\n9",), ("",), ("- 5\r\n6 -",)]
    df = spark.createDataFrame([(i * 10 + j, *a, *b) for i, a in enumerate(rows) for j, b in enumerate(rows)], "k int, a string, b string")
    whole = T.clean(F.concat(F.lit("[A 1]\n"), "a", F.lit("\n\n[B]\n"), "b", F.lit("\n\n---\n\n[C]\nend")))
    pieces = F.concat(F.lit("[A 1]"), T.clean_piece(F.col("a")), F.lit("[B]"), T.clean_piece(F.col("b")), F.lit("---\n\n[C]\nend"))
    assert df.where(~whole.eqNullSafe(pieces)).count() == 0
