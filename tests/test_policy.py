"""Normalisers, rules, scores and merges against expected values written by hand."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from policyspark import packs, registry
from policyspark.functions import extract
from policyspark.functions import text as T
from policyspark.operators import context, dictionary, findings, infer, records, rules, tiers
from policyspark.sources import tables

SF = "/root/testdata/sf0.001"


def record(**values):
    return {"filename": "f", "brand": "TREMFYA"} | {p: "NA" for p in packs.PARAMS} | values


def frame(spark, *rows):
    cols = ["filename", "brand", *packs.PARAMS]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} string" for c in cols))


def test_normalisers(spark):
    cases = {
        "age": [("18 years of age or older", ">=18"), ("6+", ">=6"), ("adults", ">=18"), ("no age limit", "No"), (" 12 ", ">=12"), ("N/A", "NA")],
        "initial_auth_duration": [("1 year", "12"), ("52 weeks", "13"), ("365 days", "12"), ("6", "6"), ("48", "1"), ("indefinite", "NA"), ("Unspecified", "NA"), ("one year", "12")],
        "tb_test_required": [("TB test not required", "Yes"), ("optional", "No"), ("Y", "Yes"), ("", "NA"), ("maybe", "maybe")],
        "steps_through_brands": [("two biologics", "2"), ("none", "NA"), ("one non-biologic", "0"), ("3 agents", "3")],
        "specialist_types": [("Dermatologist or Rheumatologist", "Dermatologist, Rheumatologist"), ("any provider", "NA"), ("board-certified", "Specialist")],
        "quantity_limits": [("45 mg every 12 weeks", "NA"), ("Quantity limit: 1 per 84 days", "Yes"), ("no limits", "No")],
    }
    for param, pairs in cases.items():
        rows = frame(spark, *[record(**{param: a, "filename": str(i)}) for i, (a, _) in enumerate(pairs)])
        got = {r["filename"]: r[param] for r in rules.normalize_records(rows).collect()}
        assert [got[str(i)] for i in range(len(pairs))] == [b for _, b in pairs], param


def test_golden_scores(spark):
    text = "Trial and failure of one conventional systemic therapy"
    rows = frame(
        spark,
        record(filename="a", step_therapy_requirements=text, steps_through_generic="1", initial_auth_duration="12", reauth_required="Yes", reauth_duration="12", reauth_requirements="Chart notes"),
        record(filename="b", step_therapy_requirements=text, age=">=18", step_through_phototherapy="Yes", initial_auth_duration="12", reauth_required="Yes", reauth_duration="12", reauth_requirements="Chart notes"),
        record(filename="c", brand="ACITRETIN", steps_through_brands="2", steps_through_generic="2", initial_auth_duration="12", reauth_required="Yes", reauth_duration="12", reauth_requirements="clinical improvement", age="Prescriber Restriction", specialist_types="Dermatologist", step_therapy_requirements=text),
        record(filename="d"),
        record(filename="e", steps_through_brands="4", steps_through_generic="3"),
    )
    got = {r["filename"]: r["access_score"] for r in rules.score_records(rows).collect()}
    assert got == {"a": 75, "b": 75, "c": 25, "d": 25, "e": 0}


def test_rules_read_input_then_corrected(spark):
    rows = frame(spark, record(reauth_requirements="Chart notes", brand="tremfya"), record(filename="g", reauth_required="Yes"))
    got = {r["filename"]: r for r in rules.enforce_rules(rows).collect()}
    assert (got["f"]["reauth_required"], got["f"]["reauth_duration"], got["f"]["brand"], got["f"]["violations"]) == ("Yes", "Unspecified", "TREMFYA", ["R2", "R6b", "R7"])
    assert got["g"]["violations"] == ["R1"]


def test_merge_ties_and_single(spark):
    cols = "filename string, brand string, chunk_no int, reasoning string, " + ", ".join(f"{p} string" for p in packs.PARAMS)
    base = [None] * 12
    rows = [("f", "b", 0, "x", ">=18", *base[1:]), ("f", "b", 1, "y", ">=16", *base[1:]), ("g", "b", 0, "z", "N/A", *base[1:])]
    got = {r["filename"]: r for r in records.merge_chunks(spark.createDataFrame(rows, cols)).collect()}
    assert (got["f"]["age"], got["f"]["reasoning"], got["f"]["quantity_limits"]) == (">=18", "x | y", "NA")
    assert got["g"]["age"] == "N/A"


def test_text_shaping(spark):
    long = "A first sentence of some length. " * 60
    r = spark.createDataFrame([(long,)], "t string").select(
        T.paragraphs(F.col("t")).alias("p"), T.sliding_chunks(F.col("t"), 500, 50).alias("c"), T.packed(F.split("t", r"(?<=\.) "), 100, " ").alias("k"), T.clean(F.lit("  a  b \n\n\n\n 12 \nx - y")).alias("l"), T.connector(F.lit("one or two")).alias("o")
    ).first()
    assert all(len(x) >= 500 for x in r["p"][:-1]) and r["c"][0] + "".join(x[50:] for x in r["c"][1:]) == long
    assert all(len(x) <= 100 for x in r["k"]) and " ".join(r["k"]).split() == long.split()
    assert r["l"].startswith("a b") and "x-y" in r["l"] and "12" not in r["l"] and r["o"] == "OR"


def test_json_salvage(spark):
    rows = [('{"age": 3}',), ('so:\n```json\n{"age": "4"}\n```',), ('well {"age": "5"} then',), ("nothing",)]
    got = [r["a"] for r in spark.createDataFrame(rows, "t string").select(T.json_salvage(F.col("t"), "age string")["age"].alias("a")).collect()]
    assert got == ["3", "4", "5", None]


@pytest.mark.parametrize("name", ["normalized", "best_record", "pending_tasks", "record_diff", "merge_records", "fill_gaps", "page_relevance", "context_pages_adjacent", "sliding_chunks", "topk_chunks", "literature_flag", "connector", "rule_priority_merge", "document_types", "preferred_status", "universal_pages", "section_paragraphs", "param_snippets", "page_tags", "drug_mentions", "rule_extract", "context_sentence", "split_failed", "file_brands", "section_ranges", "section_rules", "section_requirements", "section_steps", "layout_gate", "step_patterns", "step_analysis", "chunk_rows", "chunk_answers", "two_group_answers", "fallback_chain", "low_yield_retry", "light_validation", "prompts", "param_snippet", "param_snippet_of", "marked_sections", "packed_chunks", "paragraphs", "focused_text", "analysis_blocks", "split_given_up", "findings", "run_totals", "low_confidence"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    rows = sorted(map(str, (tuple(r) for r in want.fetchall())))
    got = registry.queries()[name](spark, SF).select(*cols)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == rows


def test_rules_win_for_their_fields_only(spark):
    """A rule's quantity limit wins, its step text doesn't."""
    rule = frame(spark, record(quantity_limits="Yes", step_therapy_requirements="by rule", age=">=6"))
    model = frame(spark, record(quantity_limits="No", step_therapy_requirements="by model", age=">=18"))
    got = records.rules_over_model(rule, model).first()
    assert (got["quantity_limits"], got["step_therapy_requirements"], got["age"]) == ("Yes", "by model", ">=6")


def test_mentions_and_steps(spark):
    """Every place, and classes by brand; P2: ALL counts two, source and connector reach from the match's ends."""
    text = "Stelara or STELARA, ustekinumab-kfce, amjevita. " + "x" * 40 + " require trial and failure of ALL preferred agents, then nothing. " + "y" * 150
    rows = spark.createDataFrame([("f", "b", text)], "filename string, brand string, text string")
    found = dictionary.places(rows, dictionary.drug_dim(spark), ["filename"]).collect()
    assert sorted((m["phrase"], m["classification"]) for m in found) == [("amjevita", "generic"), ("stelara", "branded"), ("stelara", "branded"), ("ustekinumab", "branded"), ("ustekinumab-kfce", "generic")]
    assert all(text[m["start"] : m["end"]].lower() == m["phrase"] and m["context"] == text[max(0, m["start"] - 100) : m["end"] + 100].strip() for m in found)
    hit = next(q for q in rows.select(extract.requirements(F.col("text")).alias("q")).first()["q"] if q["count"] == 2)
    at, end = text.index("require trial"), text.index("ALL preferred agents") + len("ALL preferred agents")
    assert hit["drug_type"] == "branded" and hit["source_text"] == text[at - 50 : end + 100] == text[hit["start"] : hit["end"]]


PHRASES = ["pso", "tb test", ">=18", "et al", "coal tar", "adalimumab", "adalimumab-atto", "été", "a", "no such phrase", "n=", "tier 1"]
PHRASE_TEXTS = ["Psoriasis; TB testing at >=18", "charcoal tar, coal tar and COAL TAR.", "adalimumab-atto xadalimumab", "Smith et al., n=3, ÉTÉ", "", None, "tb  test", "z" * 5000 + " pso " + "tier 12"]


@pytest.mark.parametrize("few,small", [(200, 20_000), (0, 20_000), (0, 3)])
@pytest.mark.parametrize("whole", [False, True])
def test_phrase_join_equals_brute_force(spark, monkeypatch, few, small, whole):
    """Every phrase is tried on every text, for dictionaries of few phrases, that are sent and that are shuffled; entries that share a phrase are found each."""
    monkeypatch.setattr(dictionary, "FEW", few)
    monkeypatch.setattr(dictionary, "SMALL", small)
    texts = spark.createDataFrame(list(enumerate(PHRASE_TEXTS)), "k int, text string")
    entries = dictionary.values(spark, "phrase, kind", [(p, k) for p in PHRASES for k in ("x", "y")])
    got = sorted((r["k"], r["phrase"], r["kind"]) for r in dictionary.phrases_in(texts, entries, ["k"], whole).collect())
    inside = lambda p, t: re.search(rf"\b{re.escape(p)}\b", t) if whole else p in t
    assert got == sorted((k, p, kind) for k, t in enumerate(PHRASE_TEXTS) if t for p in PHRASES if inside(p, t.lower()) for kind in "xy")


def test_drugs_of_requirements_lie_inside_their_source(spark):
    """A name outside the interval doesn't count, nor one that the interval's end cuts; a section without steps has a row in the analysis."""
    near = "humira, enbrel " + "trial of two preferred products with cimzia" + " and" + " word" * 18 + " stelara"
    rows = spark.createDataFrame([("f", "b", near), ("g", "b", "enbrel only"), ("h", "b", ""), ("i", "b", None)], "filename string, brand string, text string")
    got = context.requirement_rows(rows).collect()
    assert [(r["filename"], r["count"], r["drugs"], r["source_text"] == near[r["start"] : r["end"]]) for r in got] == [("f", 2, ["cimzia", "enbrel", "humira"], True)] * 2  # two patterns have these words
    all_ = {r["filename"]: r for r in context.step_analysis(rows).collect()}
    assert [(k, all_[k]["confidence"], len(all_[k]["requirements"]), len(all_[k]["drug_mentions"])) for k in "fghi"] == [("f", "high", 2, 4), ("g", "medium", 0, 1), ("h", "low", 0, 0), ("i", "low", 0, 0)]
    assert "2 branded from humira, enbrel" in all_["f"]["reasoning"] and all_["g"]["reasoning"] == "no pattern, drug mentions: 1"


def test_steps_behind_the_universal_text(spark):
    """Steps of the universal text aren't the section's; positions stay those of the whole text."""
    shared = "All drugs: trial of three preferred agents is needed. " * 3
    own = "Inadequate response to one preferred biologic product and methotrexate."
    rows = spark.createDataFrame([("f", "b", shared + own, shared)], "filename string, brand string, text string, universal_text string")
    got = context.requirement_rows(rows).collect()
    assert {r["count"] for r in got} == {1} and all(r["drugs"] == ["methotrexate"] for r in got)
    assert "universal text apart" in context.step_analysis(rows).first()["reasoning"]


def test_sections_of_several_drugs(spark):
    """Aliases name a section; it ends at the next opener without the name; pages without text count as empty."""
    pages = ["Index: soriatane", "Products Affected\nSORIATANE\nPrior Authorization Criteria\nAge Restrictions adults", None, "Criteria for acitretin, continued", "Products Affected\nHumira\nCriteria Details", "Drug names: Stelara"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(pages)], "filename string, page_num int, text string")
    tasks = spark.createDataFrame([("f", "Acitretin"), ("f", "STELARA"), ("f", "OTEZLA"), ("g", "STELARA"), ("f", "Acitretin")], "filename string, brand string")
    got = {r["brand"]: (r["first"], r["last"]) for r in context.section_pages(tasks, rows).collect()}
    assert got == {"Acitretin": (1, 4), "STELARA": (5, None)}
    found = context.rules_of_sections(tasks, rows).collect()  # the other section hasn't the layout
    assert [(r["brand"], r["age"], r["quantity_limits"]) for r in found] == [("Acitretin", "adults Criteria for acitretin, continued", None)]


MARKED = ["[Page 1]\nabc" + "x" * 30 + "\n\n[PsO Section | Page 2] d" + "y" * 90 + "\n\n" + "z" * 20 + "\n[Tier 1] e", "no marks\n\nat all\n\n\n" + "w" * 95, "short", "", " \n ", "v" * 130, "[Page 1] a\n\n [Page 2] b"]


def test_splitter_loses_nothing(spark):
    """Pieces fit, and put together they are the text, but for line ends between paragraphs that were taken apart."""
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in MARKED], "t string").select(T.marked_sections(F.col("t"), packs.CONTEXT_MARK, 40).alias("p")).collect()]
    for text, pieces in zip(MARKED, got):
        assert all(len(p) <= 40 for p in pieces)
        assert re.sub(r"\n{2,}", "", "".join(pieces)).strip() == re.sub(r"\n{2,}", "", text).strip()
    assert got[-1] == [MARKED[-1]] and got[5] == ["v" * 40] * 3 + ["v" * 10]


def test_pieces_of_failed_chunks(spark):
    """Halves at the last line end near the middle; under 500 characters or after three passes a failure is given up; only failures are asked again."""
    line = "a" * 301 + "\n" + "b" * 299  # the only line end is near the middle
    text = "q" * 599 + "\n"  # the only line end is last, out of reach
    long = "c" * 9000
    rows = spark.createDataFrame([("f", "b", 0, line), ("g", "b", 0, text + "q"), ("h", "b", 0, long), ("i", "b", 0, "fine")], "filename string, brand string, chunk_no int, text string")
    asked = spark.sparkContext.accumulator(0)

    def call(prompts):
        asked.add(len(prompts))
        return [infer.TOO_LARGE if len(p) > 400 else json.dumps({"age": str(len(p))}) for p in prompts]

    good, lost = infer.ask_in_pieces(rows, lambda c: c.withColumn("prompt", F.col("text")), call)
    got = sorted((r["filename"], r["path"], r["age"]) for r in good.collect())
    assert got == [("f", "a", "301"), ("f", "b", "300"), ("g", "a", "300"), ("g", "b", "301"), ("i", "", "4")]
    assert sorted((r["filename"], r["path"], r["chars"]) for r in lost.collect()) == [("h", f"{a}{b}{c}", 1125) for a in "ab" for b in "ab" for c in "ab"]
    assert asked.value == 4 + 6 + 4 + 8  # only the halves of what failed are asked about again


def test_stages_get_what_is_left(spark):
    """U4: each stage is called once, with the tasks that no earlier one answered, and not at all when none are left."""
    tasks = spark.createDataFrame([(str(i), "STELARA") for i in range(6)], "filename string, brand string")
    seen = []

    def stage(name, keep):
        def run(rows):
            seen.append((name, rows.count()))
            return rows.where(F.col("filename").cast("int") < keep).select("filename", "brand", *[F.lit(name).alias(p) for p in packs.PARAMS])

        return run

    partly = frame(spark, *[record(filename="5", brand="STELARA", age=">=4")]).replace("NA", None)
    got, flagged = infer.with_fallback(tasks, {"one": stage("one", 2), "two": stage("two", 4)}, partly)
    rows = {r["filename"]: r for r in got.collect()}
    assert seen == [("one", 6), ("two", 4)]
    assert [rows[str(i)]["stage"] for i in range(6)] == ["one", "one", "two", "two", "defaults", "defaults"]
    assert (rows["4"]["age"], rows["5"]["age"], rows["5"]["steps_through_generic"]) == (">=6", ">=4", "1")
    assert sorted(r["filename"] for r in flagged.collect()) == ["4", "5"]
    seen.clear()
    infer.with_fallback(tasks, {"one": stage("one", 9), "two": stage("two", 9)})
    assert [n for n, _ in seen] == ["one"]


def test_low_yield_conditions(spark):
    """Few real parameters, a text that fits, and another text than was read; spellings that only a merge takes for missing stay."""
    rows = frame(spark, record(filename="a"), record(filename="b"), record(filename="c"), record(filename="d", age="not specified"))
    texts = spark.createDataFrame([("a", "TREMFYA", "whole", "part"), ("b", "TREMFYA", "whole", "whole"), ("c", "TREMFYA", "w" * 99, "part"), ("d", "TREMFYA", "whole", "part")], "filename string, brand string, text string, focused string")
    again = lambda left: left.select("filename", "brand", *[F.lit("new").alias(p) for p in packs.PARAMS])
    got = {r["filename"]: r for r in infer.retry_low_yield(rows, texts, again, most=50).collect()}
    assert [got[k]["age"] for k in "abcd"] == ["new", "NA", "NA", "not specified"] and got["d"]["tb_test_required"] == "new"


def test_light_validation_reads_requirements(spark):
    """A stated requirement sets the flag, and No or Unspecified are stated durations."""
    rows = frame(spark, record(filename="a", reauth_requirements="Chart notes"), record(filename="b", reauth_duration="No"), record(filename="c", reauth_required="Yes"), record(filename="d"))
    got = {r["filename"]: (r["reauth_required"], r["reauth_duration"], r["corrections"]) for r in rules.light_validation(rows).collect()}
    assert got == {"a": ("Yes", "NA", ["reauth_required"]), "b": ("Yes", "No", ["reauth_required"]), "c": ("Yes", "Unspecified", ["reauth_duration"]), "d": ("NA", "NA", [])}


def test_reauthorisation_sentences_and_snippets(spark):
    """Lines and sentences of any length; S10: the brand alone counts."""
    text = "Continued approval needs a note. Other.\nRenewal: yes\nNothing about BRANDX here. tail"
    r = spark.createDataFrame([(text,)], "t string").select(context.reauth_sentences(F.col("t")).alias("a"), T.param_snippet(F.col("t"), "tb_test_required", 500, F.lit("brandx")).alias("b"), T.param_snippet(F.col("t"), "reauth_requirements", 10, F.lit("brandx")).alias("c")).first()
    assert r["a"] == "Continued approval needs a note.\nRenewal: yes"
    assert r["b"] == "Nothing about BRANDX here." and r["c"] == text[:10]


def test_examples_and_hints(spark):
    """Reasoning always goes, and only three fields are cut, in compact prompts only."""
    long = "v" * 100
    out = {"age": F.lit(long), "quantity_limits": F.lit(long), "age_reasoning": F.lit("why")}
    r = spark.range(1).select(infer.example_text(out, True).alias("a"), infer.example_text(out).alias("b"), infer.examples_text([("d", "s", out)]).alias("c"), infer.field_hints({"age": "how old", "tb": "a test"}, F.array(F.lit("tb"))).alias("h")).first()
    assert json.loads(r["a"]) == {"age": long, "quantity_limits": "v" * 77 + "..."} and json.loads(r["b"]) == {"age": long, "quantity_limits": long}
    assert "Context: s" in r["c"] and r["h"] == "- tb: a test"


def test_retention_touches_only_its_partitions(spark, tmp_path):
    """A10: dropping a provider, or stale validated records, leaves the files of other partitions as they are."""
    path = str(tmp_path / "store")
    rows = None
    for name, provider in (("extract", "a"), ("extract", "b"), ("validate", "a"), ("validate", "b"), ("validate", "")):
        part = frame(spark, record(filename="f"), record(filename="g")).selectExpr("*", f"'{name}' AS pass_name", f"'{provider}' AS provider")
        rows = part if rows is None else rows.unionByName(part)
    tables.write_records(rows, path)
    files = lambda: {(f.parent.parent.name, f.parent.name, f.name) for f in (tmp_path / "store").glob("*/*/*.parquet")}
    before = files()
    revised = spark.createDataFrame([("f", "TREMFYA")], "filename string, brand string").withColumn("n", F.lit(1))
    assert len(tables.drop_stale_validated(spark, path, revised)) == 3
    after = files()
    assert {x for x in before if x[0] == "pass_name=extract"} == {x for x in after if x[0] == "pass_name=extract"}
    left = tables.stored_records(spark, path)
    assert sorted(r["filename"] for r in left.where("pass_name = 'validate'").collect()) == ["g"] * 3 and left.count() == 7
    assert tables.drop_stale_validated(spark, path, revised) == []
    assert len(tables.drop_stale_validated(spark, path, revised.withColumn("filename", F.lit("g")))) == 3
    assert {x[0] for x in files()} == {"pass_name=extract"}
    assert len(tables.keep_provider(spark, path, "b")) == 1
    assert files() == {x for x in before if x[:2] == ("pass_name=extract", "provider=b")}


def test_tasks_records_and_prompts_as_files(spark, tmp_path):
    """A1: blank rows go, repeats stay in order; A3: broken records are missing; A9: prompts come back."""
    (tmp_path / "t.csv").write_text("filename,brand\n a ,B\n,B\nc,\na,B\n")
    got = tables.read_tasks(spark, str(tmp_path / "t.csv")).orderBy("row_no").collect()
    assert [(r["filename"], r["brand"]) for r in got] == [("a", "B"), ("a", "B")]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"age": 6, "corrections": ["x"]}')
    (tmp_path / "json" / "b.json").write_text('{"age": ')
    read = tables.read_records(spark, str(tmp_path / "json")).collect()
    assert [(r["age"], r["corrections"], r["file"]) for r in read] == [("6", ["x"], "a.json")]
    prompts = spark.createDataFrame([("f", "b", "p")], "filename string, brand string, prompt string")
    tables.write_prompts(prompts, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == prompts.collect()


def test_results_are_counted_while_written(spark, tmp_path):
    rows = rules.results(frame(spark, record(reauth_requirements="Chart notes"), record(filename="g")))
    totals = findings.write_results_counted(rows, str(tmp_path / "o"))
    assert totals == {"n_rows": 2, "n_fixes": sum(len(r["violations"]) for r in rows.collect()), "n_unscored": 0, "n_findings": sum(len(r["findings"]) for r in rows.collect())}
    assert tables.read_results(spark, str(tmp_path / "o")).count() == 2


def test_packing_of_lines(spark):
    """E7 on empty lists, one long part and empty parts."""
    rows = [([],), (["a" * 9],), (["", "", "b"],), (["aa", "bb", "cc"],)]
    got = [r["p"] for r in spark.createDataFrame(rows, "p array<string>").select(T.packed(F.col("p"), 5, "\n").alias("p")).collect()]
    assert got == [[], ["a" * 9], ["\n\nb"], ["aa\nbb", "cc"]]


def test_findings_of_an_empty_run_clear_it(spark, tmp_path):
    rows = spark.createDataFrame([("f", "b", "x")], "filename string, brand string, finding string")
    for run, part in (("1", rows), ("2", rows), ("1", rows.limit(0))):
        tables.write_findings(part, str(tmp_path / "f"), run)
    assert [r["run_id"] for r in tables.read_findings(spark, str(tmp_path / "f")).collect()] == [2]


def test_stored_records_come_back_normalised(spark, tmp_path):
    rows = frame(spark, record(initial_auth_duration="1 year")).selectExpr("*", "'extract' AS pass_name", "'groq' AS provider")
    tables.write_records(rows, str(tmp_path / "r"))
    got = tables.stored_records(spark, str(tmp_path / "r")).first()
    assert (got["initial_auth_duration"], got["pass_name"], got["provider"], got["filename"]) == ("12", "extract", "groq", "f")


def test_results_come_back(spark, tmp_path):
    rows = rules.results(frame(spark, record(age=">=18")))
    tables.write_results(rows, str(tmp_path / "o"))
    got = tables.read_results(spark, str(tmp_path / "o")).first()
    assert (got["filename"], got["brand"], got["age"]) == ("f", "TREMFYA", ">=18") and got["access_score"] in (0, 25, 50, 75, 100)


def test_brand_section_strategies(spark):
    fill = "z" * 6000
    cases = [
        (f"{fill} coverage of drugx here {fill}", 5503),
        (f"{fill} approval criteria {fill[:2500]} drugx {fill}", 5501),
        (f"{fill} drugx {fill[:500]} trial {fill}", 5001),
        (f"{fill} [pso section {fill}", 6001),
        (f"{fill}{fill}", 0),
    ]
    for text, start in cases:
        got = spark.createDataFrame([(text,)], "t string").select(T.brand_section(F.col("t"), [F.lit("drugx"), F.lit("")], 300).alias("s")).first()["s"]
        at = {5503: text.find("coverage of drugx") - 500, 5501: text.find("approval criteria") - 500, 5001: text.find("drugx") - 1000}.get(start, start)
        assert got == text[at : at + 300]
    assert spark.createDataFrame([("short drugx",)], "t string").select(T.brand_section(F.col("t"), [F.lit("drugx")]).alias("s")).first()["s"] == "short drugx"


def test_second_look_corrects(spark):
    """Changed fields are named; unreadable answers and records without context change nothing."""
    found = frame(spark, record(age=">=6"), record(filename="g"), record(filename="h"))
    texts = spark.createDataFrame([("f", "TREMFYA", "t"), ("g", "TREMFYA", "t")], "filename string, brand string, text string")
    call = lambda prompts: ['{"age": ">=18"}' if '">=6"' in p or ">=6" in p else "no json" for p in prompts]
    got = {r["filename"]: r for r in infer.validate_all(found, texts, "Check.", call).collect()}
    assert got["f"]["age"] == ">=18" and got["f"]["corrections"] == ["age"]
    assert got["g"]["corrections"] == [] and got["h"]["corrections"] == [] and got["h"]["age"] == "NA"


def test_inference_hook_gets_whole_prompts(spark):
    rows = spark.createDataFrame([("f", "b", "x" * 9000)], "filename string, brand string, prompt string")
    assert infer.infer(rows, lambda ps: [str(len(p)) for p in ps]).first()["answer"] == "9000"


def test_context_levels(spark):
    """S13h-S13o on one multi-drug document, by hand."""
    blank = "This page has only general remarks that concern nobody. " * 3
    pages = [blank] * 12
    pages[2] = "Drug name: STELARA\n\nPlaque psoriasis is covered for STELARA with step therapy. " + blank
    pages[6] = "Non-preferred products require trial of preferred drugs.\n\nENBREL and TREMFYA are other drugs."
    pages[9] = "STELARA is stocked here by the plan. The prescriber type is not limited at all."
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(pages)], "filename string, page_num int, text string")
    tasks = spark.createDataFrame([("f", "STELARA")], "filename string, brand string")
    got = {level: tiers.context_package(tasks, rows, level).first() for level in ("page", "paragraph", "sentence")}
    assert got["page"]["document_type"] == "multi-drug" and got["page"]["total_pages"] == 12 and got["page"]["pages_used"] == 12
    assert [r["page_num"] for r in tiers.universal_pages(rows).orderBy("page_num").collect()] == [0, 1, 6]
    assert got["paragraph"]["section_text"].startswith("[Page 3]\nPlaque psoriasis")
    assert "[PARAMETER-SPECIFIC SNIPPETS]" not in got["paragraph"]["full_text"] and got["sentence"]["full_text"].count("[Universal | Page") == 3
    plain = rows.where("page_num in (0, 1, 3, 4)")
    assert context.universal_boundary(plain).first()["boundary"] == 3 and context.universal_boundary(plain.limit(2)).first()["boundary"] == 2
    with pytest.raises(ValueError):
        tiers.context_package(tasks, rows, "word")
