"""Queries of the library and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions import extract, score
from policyspark.functions import text as T
from policyspark.operators import context, dictionary, findings, infer, quality, records, report, rules, tiers
from policyspark.plans import oracle
from policyspark.sources import fixtures, tables

Query = Callable[[SparkSession, str], DataFrame]
P = packs.PARAMS
KEYS = ["filename", "brand"]


def _raw(s, d, shift=0):
    return fixtures.raw_params(s, d, shift)


def _normal(s, d):
    return rules.normalize_records(_raw(s, d))


def _scored(s, d):
    return rules.score_records(_normal(s, d))


def _results(s, d):
    return rules.results(_raw(s, d)).select(*KEYS, "access_score", *P, "violations")


def _findings(s, d):
    """Findings of every check of a run."""
    rows = rules.results(_raw(s, d))
    warned = rules.sanity(_scored(s, d)).withColumn("brand", F.upper("brand"))
    gaps = quality.completeness(_raw(s, d), P)
    pairs = quality.pair_gaps(_expected_pairs(s, d), fixtures.submissions(s, d))
    return findings.together(findings.of_consistency(quality.consistency(rows)), findings.of_drift(quality.drift(rows, _expected(s))), findings.of_completeness(gaps), findings.of_pairs(pairs), findings.of_sanity(warned), findings.of_rules(rows))


def _tasks_of_orders(s, d, name="Brand#"):
    return fixtures.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("filename"), F.concat(F.lit(name), (1 + F.col("o_orderkey") % 40).cast("string")).alias("brand"))


def _docs(s, d):
    return fixtures.table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("filename"), "text")


def _scored_pages(s, d):
    return context.scored_pages(fixtures.submissions(s, d), fixtures.policy_pages(s, d), oracle.PAGE_PACK)


def _expected(s):
    rows = [(b, c, v, float(p)) for b, cs in oracle.derived_expectations().items() for c, vs in cs.items() for v, p in vs.items()]
    return s.createDataFrame(rows, "brand string, column string, value string, pct double")


def _expected_pairs(s, d):
    extra = s.createDataFrame([("x1", "A"), ("x2", "B"), ("x3", "C")], "filename string, brand string")
    return fixtures.submissions(s, d).where("row_no % 5 <> 0").select(*KEYS).unionByName(extra)


def _task_texts(s, d):
    return fixtures.submissions(s, d).join(_docs(s, d).select("filename", "text"), "filename")


def _dry_run(s, d):
    n = F.length("text")
    return _task_texts(s, d).agg(F.count("*").alias("n_tasks"), F.sum(n).alias("chars"), F.avg(n).alias("mean_chars"), F.floor(F.sum(n) / 4).alias("tokens"))


def _worded(s, d):
    return fixtures.worded_tasks(s, d), fixtures.worded_pages(s, d)


def _sections(s, d):
    return fixtures.section_tasks(s, d), fixtures.section_pages(s, d)


def _page_sections(s, d):
    """Each worded page as a section of its own."""
    return fixtures.worded_pages(s, d).select("filename", F.col("page_num").cast("string").alias("brand"), "text")


def _requirements(sections):
    return context.requirement_rows(sections).select(*KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("no")).alias("no"), "count", "drug_type", "connector", "source_text", F.array_join("drugs", ",").alias("drugs")).withColumn("no", F.col("no") - 1)


def _steps(found):
    return found.select(*KEYS, "branded_steps", "generic_steps", "confidence", "phototherapy_mandatory", "phototherapy_in_or", F.size("requirements").alias("n_requirements"), F.size("drug_mentions").alias("n_mentions"), "reauth_text")


def _snippets(s, d):
    tasks, pages = _worded(s, d)
    return tiers.snippet_rows(tasks, pages, tiers.paragraph_rows(tasks, pages))


def _confidence(s, d):
    return _scored(s, d).select(*KEYS, score.confidence(F.col("estimated_access_score"), F.col("access_score")).alias("c")).select(*KEYS, "c.*")


def _calls(s, d):
    key = F.col("o_orderkey")
    return fixtures.table(s, d, "orders").select(F.concat(F.lit("p"), (key % 3).cast("string")).alias("provider"), (key % 5 == 0).alias("hit"), (key % 9000).alias("chars"))


def _prompts(s, d):
    """Each task's prompt, with a compact example of its own record and what is known of its document."""
    shown = {p: F.col(p) for p in ("age", "step_therapy_requirements", "reauth_requirements")} | {"age_reasoning": F.lit("left out")}
    text = F.concat_ws("; ", "specialist_types", "initial_auth_duration")
    kind = F.when(F.col("tb_test_required") == "Y", "decision-tree").otherwise("multi-drug")
    tree = F.when(kind == "decision-tree", "Follow the tree.")
    task = infer.prompt("Extract the parameters.", text, F.nullif(F.col("quantity_limits"), F.lit("No")), tree, {"Filename": F.col("filename"), "Target Brand": F.col("brand"), "Document Type": kind}, "Return JSON only.")
    examples = infer.examples_text([("own record", "none", shown)], compact=True)
    return _raw(s, d).select(*KEYS, infer.full_prompt(examples, task).alias("prompt"))


def _chunks(s, d):
    return infer.chunk_rows(fixtures.contexts(s, d), 3500)


def _small_prompt(rows):
    return rows.withColumn("prompt", infer.small_prompt(infer.field_hints({"age": "the age that is required"}), F.col("text"), F.col("universal_text"), F.col("brand")))


def _large_prompt(rows):
    return rows.withColumn("prompt", infer.prompt("Extract the parameters.", F.col("text"), F.col("universal_text")))


def _chunk_answers(s, d):
    return infer.extract_chunks(_chunks(s, d), fixtures.small_model, fixtures.large_model, _small_prompt, _large_prompt)


def _two_group_answers(s, d):
    simple = lambda rows: rows.withColumn("prompt", F.concat(F.lit("Policy text:\n"), "text", F.lit("\n\nPOLICY TEXT:\n"), "text"))
    confirm = lambda rows: rows.withColumn("prompt", F.concat("analysis", F.lit("\n\nPolicy text:\n"), "text", F.lit("\n\nPOLICY TEXT:\n"), "text"))
    direct = lambda rows: rows.withColumn("prompt", infer.prompt("Extract.", F.col("text")))
    return infer.extract_two_groups(_chunks(s, d).drop("universal_text"), fixtures.small_model, fixtures.large_model, simple, confirm, direct)


def _fallback(s, d):
    """Rules, chunks, small, large and simplified prompts, then defaults, each for what is left."""
    contexts = fixtures.contexts(s, d)
    chunks = infer.chunk_rows(contexts, 3500)
    own = lambda left: chunks.join(left.select(*KEYS), KEYS, "left_semi")
    whole = lambda left: own(left).where("not chunked")
    head = lambda left: contexts.join(left.select(*KEYS), KEYS, "left_semi").withColumn("text", F.substring("text", 1, 800))
    stages = {
        "chunked": lambda left: infer.extract_chunks(own(left).where("chunked"), fixtures.small_model, fixtures.large_model, _small_prompt, _large_prompt),
        "small": lambda left: infer.answered(_small_prompt(whole(left)), fixtures.small_model, KEYS),
        "large": lambda left: infer.answered(_large_prompt(whole(left)), fixtures.large_model, KEYS),
        "simplified": lambda left: infer.answered(_large_prompt(head(left)), fixtures.large_model, KEYS),
    }
    rules_of = context.rules_of_sections(contexts.select(*KEYS), fixtures.section_pages(s, d))
    return infer.with_fallback(contexts.select(*KEYS), stages, rules_of)[0]


def _low_yield(s, d):
    """Records filled from a second pass where few parameters are real, the text fits and the first pass read a part of it."""
    record = _raw(s, d)
    n = F.length(F.concat_ws("", *P))
    texts = record.select(*KEYS, F.repeat(F.lit("x"), n).alias("text"), F.repeat(F.lit("x"), F.when(n % 3 == 0, n).otherwise(F.lit(9))).alias("focused"))
    return infer.retry_low_yield(record, texts, lambda left: _raw(s, d, 1).join(left.select(*KEYS), KEYS, "left_semi"), most=150, least=9)


def _budget_prefix(s, d):
    kept = T.prefix_within(F.split("text", "\n"), 1500)
    return _docs(s, d).select("doc_id", kept.alias("k")).select("doc_id", F.size("k").alias("n_lines"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


def _layout(s, d):
    """Section texts in the labelled layout, from derived records."""
    r = _raw(s, d)
    text = F.concat(F.lit("Products Affected\nPrior Authorization Criteria\nRequired Medical Information "), F.col("step_therapy_requirements"), F.lit(". Trial of two preferred products or phototherapy. Methotrexate was ineffective.\nAge Restrictions "), F.col("age"), F.lit("\nPrescriber Restrictions "), F.col("specialist_types"), F.lit("\nCoverage Duration Initial: 6 months, Renewal: 12 months\nRenewal Criteria "), F.col("reauth_requirements"), F.lit(" reauthorization needs a negative tuberculin test.\nEffective Date 01/01"))
    return r.select(*KEYS, text.alias("text"))


def queries() -> dict[str, Query]:
    def na_to_null(df):
        return df.withColumns({p: F.nullif(F.col(p), F.lit("NA")) for p in P})

    return {
        "raw_params": _raw,
        "normalized": lambda s, d: _normal(s, d).select(*KEYS, *P),
        "access_score": lambda s, d: _scored(s, d).select(*KEYS, "access_score"),
        "business_rules": lambda s, d: _results(s, d).withColumn("violations", F.array_join("violations", ",")),
        "score_brand_summary": lambda s, d: report.brand_summary(_results(s, d)),
        "score_histogram": lambda s, d: report.score_histogram(_results(s, d)),
        "brand_mean_sorted": lambda s, d: report.brand_means(_results(s, d)),
        "step_burden": lambda s, d: report.step_burden(_results(s, d)),
        "step_burden_melt": lambda s, d: report.burden_long(report.step_burden(_results(s, d))),
        "kpi_row": lambda s, d: report.kpis(_results(s, d), _tasks_of_orders(s, d, "BRAND#")),
        "score_breakdown": lambda s, d: rules.breakdown(_scored(s, d)),
        "score_confidence": lambda s, d: _scored(s, d).select(*KEYS, score.confidence(F.col("estimated_access_score"), F.col("access_score")).alias("c")).select(*KEYS, "c.*"),
        "score_sanity": lambda s, d: rules.sanity(_scored(s, d)),
        "rescore_changes": lambda s, d: rules.rescore(_results(s, d)).select(*KEYS, "old_score", "new_score", "changed"),
        "light_validation": lambda s, d: rules.light_validation(_raw(s, d)).select(*KEYS, "reauth_required", "reauth_duration", F.array_join("corrections", ",").alias("corrections")),
        "cross_row_consistency": lambda s, d: quality.consistency(_results(s, d)),
        "distribution_drift": lambda s, d: quality.drift(_results(s, d), _expected(s)),
        "completeness": lambda s, d: quality.completeness(_raw(s, d), P),
        "expected_vs_actual": lambda s, d: quality.pair_gaps(_expected_pairs(s, d), fixtures.submissions(s, d)),
        "run_totals": lambda s, d: report.run_totals(rules.results(_raw(s, d))),
        "findings": lambda s, d: _findings(s, d).withColumn("detail", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("detail"))))),
        "finding_counts": lambda s, d: findings.counts(_findings(s, d)),
        "low_confidence": lambda s, d: report.not_high(_confidence(s, d)).select(*KEYS, "llm_estimate", "deterministic", "level"),
        "completion_by_file": lambda s, d: report.completion(_tasks_of_orders(s, d), fixtures.records(s, d)),
        "provider_counts": lambda s, d: report.provider_counts(fixtures.records(s, d)),
        "best_record": lambda s, d: records.best_records(fixtures.records(s, d).select(*KEYS).distinct(), fixtures.records(s, d)).select(*KEYS, "pass_name", "provider", *P),
        "pending_tasks": lambda s, d: records.pending(_tasks_of_orders(s, d).distinct(), fixtures.records(s, d)),
        "record_diff": lambda s, d: records.diff(_raw(s, d, 1).select(*KEYS, *P), _raw(s, d).select(*KEYS, *P)),
        "merge_records": lambda s, d: records.merge_chunks(fixtures.chunk_records(s, d)),
        "fill_gaps": lambda s, d: records.fill_gaps(_raw(s, d), _raw(s, d, 1)),
        "rule_priority_merge": lambda s, d: records.rules_over_model(na_to_null(_raw(s, d)), _raw(s, d, 1)),
        "fallback_chain": lambda s, d: _fallback(s, d),
        "chunk_rows": lambda s, d: _chunks(s, d).select(*infer.CHUNK, "chunked", "route", F.length("universal_text").alias("universal_chars"), F.length("text").alias("chars"), F.md5("text").alias("text_md5")),
        "chunk_answers": _chunk_answers,
        "two_group_answers": _two_group_answers,
        "focused_text": lambda s, d: _docs(s, d).select("doc_id", T.focused(F.col("text"), F.array(*[F.lit(w) for w in ("license", "token", "mail")]), 7000).alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5")),
        "analysis_blocks": lambda s, d: infer.with_analysis(_page_sections(s, d), KEYS).select(*KEYS, F.length("analysis").alias("chars"), "analysis"),
        "first_n_tasks": lambda s, d: tables.first_tasks(fixtures.submissions(s, d), n=50),
        "page_relevance": lambda s, d: _scored_pages(s, d).select(*KEYS, "page_num", "relevance"),
        "page_profile": lambda s, d: report.page_profile(_scored_pages(s, d)),
        "relevance_band": lambda s, d: _scored_pages(s, d).groupBy(report.relevance_band(F.col("relevance")).alias("band")).agg(F.count("*").alias("n")),
        "context_reduction": lambda s, d: report.context_reduction(_scored_pages(s, d), 1.0),
        "context_pages_adjacent": lambda s, d: context.tagged_pages(_scored_pages(s, d)).select(*KEYS, "page_num", "tag"),
        "context_page": lambda s, d: context.page_context(context.tagged_pages(_scored_pages(s, d))),
        "context_paragraph": lambda s, d: tiers.paragraph_rows(*_worded(s, d)),
        "context_sentence": lambda s, d: context.sentence_context(context.task_pages(fixtures.submissions(s, d), fixtures.policy_pages(s, d)), {"license": ["license", "mail"], "token": ["token", "the"]}),
        "doc_type_counts": lambda s, d: context.document_types(fixtures.worded_pages(s, d)).groupBy("document_type").agg(F.count("*").alias("n")),
        "preferred_status": lambda s, d: context.preferred_status(context.task_pages(*_worded(s, d))),
        "universal_boundary": lambda s, d: context.universal_boundary(fixtures.worded_pages(s, d)),
        "section_span": lambda s, d: context.section_span(context.task_pages(fixtures.submissions(s, d), fixtures.policy_pages(s, d)), F.contains("low", F.lit("the")), F.contains("low", F.lit("license"))).select(*KEYS, "page_num"),
        "literature_flag": lambda s, d: _docs(s, d).select("doc_id", T.count_all(F.lower("text"), packs.STUDY_PATTERNS).cast("long").alias("n_study"), T.count_all(F.lower("text"), packs.POLICY_PATTERNS).cast("long").alias("n_policy")),
        "studies": lambda s, d: fixtures.study_texts(s, d).select(*KEYS, T.is_literature(F.col("text"), F.col("brand"), context.generic_of(F.col("brand"))).alias("study")),
        "connector": lambda s, d: _docs(s, d).select("doc_id", T.connector(F.col("text")).alias("connector")),
        "token_budget": lambda s, d: _docs(s, d).select("doc_id", T.context_chars(F.length("text"), 6000, 2000).alias("chars")),
        "sliding_chunks": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(T.sliding_chunks(F.col("text"))).alias("chunk_no", "chunk")),
        "topk_chunks": lambda s, d: context.top_chunks(_docs(s, d), ["license", "token", "mail"]),
        "budget_prefix": _budget_prefix,
        "dry_run": _dry_run,
        "paragraphs": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("ord", "para")),
        "sentences": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence")),
        "packed_chunks": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(T.packed(F.split("text", "\n"), 2000, "\n")).alias("chunk_no", "chunk")),
        "clean_text": lambda s, d: _docs(s, d).select("doc_id", T.clean(F.col("text")).alias("text")),
        "brand_window": lambda s, d: _docs(s, d).select("doc_id", T.window_around(F.col("text"), [F.lit("license")], 2000, 1000).alias("text")),
        "param_snippet": lambda s, d: _docs(s, d).select("doc_id", T.snippet(F.col("text"), ["license", "token"], 500, F.lit("mail")).alias("text")),
        "param_snippet_of": lambda s, d: context.section_texts(*_sections(s, d)).select(*KEYS, *[T.param_snippet(F.col("text"), p, 400, F.col("brand")).alias(p) for p in packs.SIMPLE_PARAMS]),
        "routes": lambda s, d: context.routes(_docs(s, d)).groupBy("route").agg(F.count("*").alias("n")),
        "rule_extract": lambda s, d: context.rule_extract(_layout(s, d)),
        "step_analysis": lambda s, d: _steps(context.step_analysis(_page_sections(s, d))),
        # sections of several drugs in one document, found by their names
        "section_ranges": lambda s, d: context.section_pages(*_sections(s, d)),
        "section_texts": lambda s, d: context.section_texts(*_sections(s, d)),
        "section_rules": lambda s, d: context.rules_of_sections(*_sections(s, d)),
        "section_steps": lambda s, d: _steps(context.step_analysis(context.section_texts(*_sections(s, d)))),
        "section_requirements": lambda s, d: _requirements(context.section_texts(*_sections(s, d))),
        # policy pages in the pack's own vocabulary
        "document_types": lambda s, d: context.document_types(fixtures.worded_pages(s, d)),
        "universal_pages": lambda s, d: tiers.universal_pages(fixtures.worded_pages(s, d)),
        "section_paragraphs": lambda s, d: tiers.section_rows(*_worded(s, d)),
        "param_snippets": lambda s, d: _snippets(s, d).select(*KEYS, "page_num", "param", "sent", "snippet"),
        "page_tags": lambda s, d: tiers.page_tags(*_worded(s, d)).select(*KEYS, "page_num", "tag", "score", "included"),
        "renewal_pages": lambda s, d: tiers.renewal_rows(tiers.page_tags(*_worded(s, d))).select(*KEYS, "page_num", "turn"),
        "limit_pages": lambda s, d: tiers.limit_rows(tiers.page_tags(*_worded(s, d))).select(*KEYS, "page_num"),
        "context_package_page": lambda s, d: tiers.context_package(*_worded(s, d), "page"),
        "context_package_paragraph": lambda s, d: tiers.context_package(*_worded(s, d), "paragraph"),
        "context_package_sentence": lambda s, d: tiers.context_package(*_worded(s, d), "sentence"),
        "dry_run_by_type": lambda s, d: report.dry_run_by_type(tiers.context_package(*_worded(s, d), "paragraph")),
        "drug_mentions": lambda s, d: dictionary.places(fixtures.worded_pages(s, d), dictionary.drug_dim(s), ["filename", "page_num"]).groupBy(F.col("phrase").alias("name"), "classification").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("chars")),
        "step_patterns": lambda s, d: _requirements(_page_sections(s, d)),
        "layout_gate": lambda s, d: context.section_texts(*_sections(s, d)).select(*KEYS, extract.laid_out(F.col("text")).alias("laid_out")),
        "simple_values": lambda s, d: _raw(s, d).select(*KEYS, *[extract.plain_value(p, F.col(p)).alias(p) for p in packs.SIMPLE_PARAMS]),
        "brand_section": lambda s, d: _docs(s, d).select("doc_id", T.brand_section(F.col("text"), [F.lit("license"), F.lit("")], 2400, 1000).alias("section")),
        "marked_sections": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(T.marked_sections(F.col("text"), r"\n[A-Z]", 2000)).alias("ord", "section")),
        "safe_keys": lambda s, d: _tasks_of_orders(s, d).distinct().select(*KEYS, T.safe_key(F.concat_ws(" ", *KEYS)).alias("key")),
        # small projections and aggregates
        "confidence_counts": lambda s, d: report.confidence_counts(_confidence(s, d)),
        "file_brands": lambda s, d: report.file_brands(fixtures.submissions(s, d)),
        "run_statistics": lambda s, d: report.run_statistics(_calls(s, d)),
        "selected_tasks": lambda s, d: tables.selected(fixtures.submissions(s, d), ["Brand#1", "Brand#2", "Brand#8"], _expected_pairs(s, d)),
        "filtered_results": lambda s, d: tables.filtered(_results(s, d), brand="BRAND#3").select(*KEYS, "access_score"),
        "kept_records": lambda s, d: records.keep_provider(fixtures.records(s, d), "groq").select(*KEYS, "pass_name", "provider"),
        "stale_records": lambda s, d: records.drop_stale_validated(fixtures.records(s, d), _tasks_of_orders(s, d).where("brand < 'Brand#2'")).select(*KEYS, "pass_name", "provider"),
        "record_hits": lambda s, d: records.hits(_tasks_of_orders(s, d).distinct(), fixtures.records(s, d)),
        "two_groups": lambda s, d: infer.two_groups(_raw(s, d), _raw(s, d, 1), packs.SIMPLE_PARAMS),
        "low_yield_retry": _low_yield,
        "split_failed": lambda s, d: infer.split_failed(_docs(s, d).select("doc_id", "text"), lambda rows: rows.where(F.length("text") > 700), ["doc_id"])[0].select("doc_id", "path", F.length("text").alias("chars"), F.md5("text").alias("text_md5")),
        "split_given_up": lambda s, d: infer.split_failed(_docs(s, d).select("doc_id", "text"), lambda rows: rows.where(F.length("text") > 700), ["doc_id"])[1].select("doc_id", "path", F.length("text").alias("chars")),
        "few_shot": lambda s, d: _raw(s, d).select(*KEYS, F.array_join(infer.few_shot_ids(F.col("brand"), 1, {"BRAND#1": 4, "BRAND#2": 5}, [2, 3]), ",").alias("examples")),
        "prompts": lambda s, d: _prompts(s, d).select(*KEYS, F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5")),
        "chunk_budgets": lambda s, d: _docs(s, d).select("doc_id", *[c.alias(n) for c, n in zip(infer.chunk_budgets(F.lit(3000), F.col("text")), ("with_universal", "without"))]),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
