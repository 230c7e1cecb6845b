"""Context of a task from its document's pages (A2, C1, S13, E2-E10), chunks (E5, S4, U3) and extraction (X, P)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions import extract
from policyspark.functions import text as T
from policyspark.functions.normalize import any_in, strip
from policyspark.operators import dictionary
from policyspark.operators.repeats import Texts, sent
from policyspark.operators.stages import settle

TASK = ["filename", "brand"]


def generic_of(brand: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for b, g in packs.BRAND_GENERIC.items():
        found = found.when(F.upper(brand) == b, g)
    return found


def task_pages(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each task and page; a page's own columns are computed before they multiply by brand."""
    own = pages.select("filename", "page_num", "text", F.lower("text").alias("low"))
    return tasks.select(*TASK).distinct().join(own, "filename")


def settled_tasks(tasks: DataFrame) -> DataFrame:
    """The distinct tasks, settled and sent to every task of Spark's if they are few."""
    return sent(settle(tasks.select(*TASK).distinct()))


def scored_pages(tasks: DataFrame, pages: DataFrame, keywords: DataFrame | dict | None = None) -> DataFrame:
    """S13d over all task pages: relevance and categories.

    ``keywords``: a dictionary (category, phrase, weight), or one of lists. Pages meet
    its phrases and the tasks' brands once each; what was found is a few short rows a page, and the
    text joins them at the end. Of ``other_brands`` the task's own names don't count.
    """
    spark = pages.sparkSession
    table = keywords if isinstance(keywords, DataFrame) else dictionary.keyword_dim(spark, keywords)
    page = ["filename", "page_num"]
    hits = dictionary.phrases_in(pages.select(*page, "text"), table, page).drop("text")
    other = F.col("category") == "other_brands"
    found = hits.groupBy(*page).agg(F.collect_set(F.when(~other, F.struct("category", "weight"))).alias("_found"), F.collect_set(F.when(other, F.col("phrase"))).alias("_others"), F.max(F.when(other, F.col("weight"))).alias("_other_weight"))
    names = tasks.select("brand").distinct().withColumn("phrase", F.explode(F.array(F.lower("brand"), F.coalesce(F.lower(generic_of(F.col("brand"))), F.lit("")))))
    named = dictionary.phrases_in(pages.select(*page, "text"), names, page).select(*page, "brand").distinct().withColumn("_target", F.lit(True))
    rows = tasks.select(*TASK).distinct().join(pages.select(*page), "filename").join(found, page, "left").join(named, [*page, "brand"], "left")
    own = F.array(F.lower("brand"), F.coalesce(F.lower(generic_of(F.col("brand"))), F.lit("")))
    others = F.coalesce(F.size(F.array_except("_others", own)), F.lit(0)) > 0
    more = F.when(others, F.array(F.struct(F.lit("other_brands").alias("category"), F.col("_other_weight").alias("weight")))).otherwise(F.array())
    target = F.when(F.col("_target"), F.array(F.struct(F.lit("target_brand").alias("category"), F.lit(packs.TARGET_WEIGHT).alias("weight")))).otherwise(F.array())
    kind = "array<struct<category:string,weight:double>>"
    every = F.concat(F.coalesce(F.col("_found"), F.array()).cast(kind), more.cast(kind), target.cast(kind))
    rows = rows.withColumn("_all", every)
    points = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["weight"])
    names_of = F.array_sort(F.transform("_all", lambda x: x["category"]))
    scored = rows.select(*TASK, "page_num", points.alias("relevance"), names_of.alias("categories"))
    return scored.join(pages.select(*page, "text"), page).select(*TASK, "page_num", "text", "relevance", "categories")


def tagged_pages(scored: DataFrame, least: float = 3.0) -> DataFrame:
    """Relevant pages, and as context the pages right before and after them.

    In files of more than 50 pages a relevant page must name the disease or the
    target brand; neighbours are found anew after that.
    """
    w = Window.partitionBy(*TASK)
    n = F.count("*").over(w)
    firm = F.array_contains("categories", "disease") | F.array_contains("categories", "target_brand")
    kept = scored.withColumn("relevant", (F.col("relevance") >= least) & ((n <= 50) | firm))
    near = w.orderBy("page_num")
    beside = F.coalesce(F.lag("relevant").over(near), F.lit(False)) | F.coalesce(F.lead("relevant").over(near), F.lit(False))
    return kept.withColumn("tag", F.when(F.col("relevant"), "relevant").when(beside, "context").otherwise("irrelevant")).drop("relevant")


def page_context(tagged: DataFrame) -> DataFrame:
    """S13h, D19: the text of relevant and context pages in order, cleaned."""
    said = F.array_sort(F.collect_list(F.when(F.col("tag") != "irrelevant", F.struct("page_num", "text"))))
    used = F.count(F.when(F.col("tag") != "irrelevant", 1))
    by = tagged.groupBy(*TASK).agg(F.count("*").alias("total_pages"), used.alias("pages_used"), F.array_join(F.transform(said, lambda x: x["text"]), "\n\n").alias("text"))
    return by.withColumn("text", T.clean(F.col("text")))


def sentence_context(pages: DataFrame, words: dict[str, list[str]], per_param: int = 5) -> DataFrame:
    """Sentences with a parameter's words, each with its neighbours.

    ``pages`` has filename, brand, page_num and text; ``words`` each parameter's
    keywords. Snippets that begin with the same 100 characters as an earlier
    one, in the order of page, parameter and sentence, go; then each parameter
    of a task keeps its first ``per_param``.
    """
    rows = pages.select(*TASK, "page_num", F.posexplode(T.sentences(F.col("text"))).alias("sent", "s"))
    w = Window.partitionBy(*TASK, "page_num").orderBy("sent")
    hits = F.array_compact(F.array(*[F.when(any_in(F.lower("s"), ws), F.struct(F.lit(k).alias("ord"), F.lit(p).alias("param"))) for k, (p, ws) in enumerate(words.items())]))
    rows = rows.withColumn("around", F.concat_ws(" ", F.lag("s").over(w), F.col("s"), F.lead("s").over(w))).select(*TASK, "page_num", "sent", "around", F.explode(hits).alias("h")).select(*TASK, "page_num", "sent", "around", "h.*")
    once = F.row_number().over(Window.partitionBy(*TASK, F.substring("around", 1, 100)).orderBy("page_num", "ord", "sent"))
    rows = rows.withColumn("n", once).where("n = 1")
    place = F.row_number().over(Window.partitionBy(*TASK, "param").orderBy("page_num", "sent"))
    return rows.withColumn("n", place).where(F.col("n") <= per_param).select(*TASK, "param", "page_num", "sent", "around")


def document_types(pages: DataFrame, names: dict[str, str] | None = None, texts: Texts | None = None) -> DataFrame:
    """S13e, D14, D15: filename, n_pages, n_brands, catalog, jumps and the type of each document.

    ``names``: what a page can call a brand, and the brand that each name stands
    for. Catalog pages are counted among the first ten pages, pages with a jump
    among the first 30.
    """
    texts = texts or Texts(pages)
    low = F.lower("text")
    catalog = (F.col("page_num") < 10) & F.contains(low, F.lit(packs.CATALOG_MARKS[0])) & F.contains(low, F.lit(packs.CATALOG_MARKS[1]))
    jump = (F.col("page_num") < 30) & low.rlike(packs.JUMP_PATTERN)
    marks = pages.where("page_num < 30").groupBy("filename").agg(F.count(F.when(catalog, 1)).alias("catalog"), F.count(F.when(jump, 1)).alias("jumps"))
    none = F.lit(0).cast("long")
    pieces = pages.groupBy("filename").agg(F.count("*").alias("n_pages")).join(marks.withColumnRenamed("filename", "_f"), F.col("filename").eqNullSafe(F.col("_f")), "left")
    pieces = pieces.select("filename", "n_pages", *[F.coalesce(c, none).alias(c) for c in ("catalog", "jumps")])
    dim = dictionary.canonical_dim(pages.sparkSession, names)
    hits = texts.seen(texts.rows.select("filename", texts.key), lambda rows: dictionary.phrases_in(rows, dim, [c for c in rows.columns if c != "text"]))
    brands = hits.groupBy("filename").agg(F.count_distinct("stands_for").cast("int").alias("n_brands"))
    counts = pieces.join(brands, "filename", "left").select("filename", "n_pages", F.coalesce("n_brands", F.lit(0)).alias("n_brands"), "catalog", "jumps")
    kind = F.when((F.col("n_brands") <= 1) | (F.col("n_pages") <= 10), "single-drug").when((F.col("catalog") >= 3) & (F.col("n_pages") > 50), "flat-catalog").when(F.col("jumps") >= 5, "decision-tree").otherwise("multi-drug")
    return counts.withColumn("document_type", kind)


def preferred_status(pages: DataFrame) -> DataFrame:
    """The status that the first of 15 pages states of the task's brand or its generic, within 200 characters.

    ``pages``: filename, brand, page_num, text.
    """
    low, brand, generic = F.lower("text"), F.lower("brand"), generic_of(F.col("brand"))
    quoted = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    near = F.lit(".{0,200}")
    out, good = F.lit(False), F.lit(False)
    for name in (brand, generic):
        known = name != ""
        out = out | (known & (F.rlike(low, F.concat(F.lit("non-preferred"), near, quoted(name))) | F.rlike(low, F.concat(quoted(name), near, F.lit("non-preferred")))))
        at = F.regexp_instr(low, F.concat(F.lit("preferred"), near, quoted(name)))
        before = F.substring(low, F.greatest(at - 15, F.lit(1)), F.least(at - 1, F.lit(15)))
        good = good | (known & (at > 0) & ~F.contains(before, F.lit("non-preferred")))
    status = F.when((F.contains(low, F.lit("non-preferred")) | F.contains(low, F.lit("non preferred"))) & out, "non-preferred").when(good, "preferred")
    stated = pages.where("page_num < 15").withColumn("status", status).where("status is not null")
    first = stated.groupBy(*[F.col(k).alias(f"_{k}") for k in TASK]).agg(F.min_by("status", "page_num").alias("status"))
    same = F.col("filename").eqNullSafe(F.col("_filename")) & F.col("brand").eqNullSafe(F.col("_brand"))
    return pages.select(*TASK).distinct().join(first, same, "left").select(*TASK, F.coalesce("status", F.lit("unknown")).alias("preferred_status"))


def section_span(pages: DataFrame, start: Column, opens: Column) -> DataFrame:
    """Pages from the first that ``start`` holds for to before the next that ``opens`` another section."""
    whole = Window.partitionBy(*TASK)
    rows = pages.withColumn("b", F.min(F.when(start, F.col("page_num"))).over(whole)).withColumn("o", opens & ~start)
    return rows.withColumn("e", F.min(F.when(F.col("o") & (F.col("page_num") > F.col("b")), F.col("page_num"))).over(whole)).where((F.col("page_num") >= F.col("b")) & (F.col("e").isNull() | (F.col("page_num") < F.col("e")))).drop("b", "e", "o")


def universal_boundary(pages: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Filename and boundary, the first of ten pages of at least 100 characters that begins a drug's section.

    At least 1; without such a page 3, or all pages if there are fewer.
    """
    low = strip(F.lower("text"))
    head = F.substring(low, 1, 500)
    begins = reduce(lambda a, b: a | b, [head.rlike(f"(?m){p}") for p in patterns or packs.SECTION_PATTERNS])
    hit = (F.col("page_num") < 10) & (F.length(low) >= 100) & begins
    by = pages.groupBy("filename").agg(F.min(F.when(hit, F.col("page_num"))).alias("at"), F.count("*").alias("n"))
    return by.select("filename", F.when(F.col("at").isNull(), F.least(F.lit(3), F.col("n").cast("int"))).otherwise(F.greatest("at", F.lit(1))).cast("int").alias("boundary"))


def top_chunks(docs: DataFrame, words: list[str], most: int = 8) -> DataFrame:
    """E5: a document's best chunks by keyword hits, with the chunks beside them; its first three if none hits.

    docs: filename, text. The ranking works on (chunk number, score) pairs of
    one document at a time, in arrays, so no text is shuffled.
    """
    cut = docs.select("filename", T.sliding_chunks(F.col("text")).alias("chunks"))
    hits = lambda c: sum((F.contains(F.lower(c), F.lit(w)).cast("int") for w in words), F.lit(0))
    scored = cut.withColumn("ranked", F.array_sort(F.filter(F.transform("chunks", lambda c, i: F.struct((-hits(c)).alias("s"), i.alias("i"))), lambda x: x["s"] < 0)))
    near = F.flatten(F.transform(F.slice("ranked", 1, most), lambda x: F.array(x["i"] - 1, x["i"], x["i"] + 1)))
    chosen = F.when(F.size("ranked") > 0, near).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    numbers = F.array_sort(F.array_distinct(F.filter(chosen, lambda i: (i >= 0) & (i < F.size("chunks")))))
    return scored.select("filename", F.explode(F.transform(numbers, lambda i: F.struct(i.alias("chunk_no"), F.element_at("chunks", i + 1).alias("chunk")))).alias("c")).select("filename", "c.*")


def routes(contexts: DataFrame, small: tuple[int, int] = (6000, 500), large: tuple[int, int] = (12000, 2000), overhead: int = 3000) -> DataFrame:
    """Where a task's context fits, and the budget of a chunk where it fits nowhere."""
    n, cost = F.length("text"), F.lit(overhead)
    a, b = T.context_chars(cost, *small), T.context_chars(cost, *large)
    return contexts.withColumn("route", F.when(n <= a, "small").when(n <= b, "large").otherwise("chunked")).withColumn("chunk_chars", F.when(n <= a, a).otherwise(b))


def section_pages(tasks: DataFrame, pages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """E4 with its default predicates: filename, brand, first and last (exclusive, null: the end) page of each task's section.

    A section starts at the first page that names the brand or an alias of it
    (brand in upper case, phrase) and has a start mark in its first 1200 characters.
    It ends before the next page that opens a section without naming it.
    Pages are looked at once, for all brands; windows run over page numbers and flags.
    """
    page = ["filename", "page_num"]
    table = aliases if aliases is not None else dictionary.alias_dim(pages.sparkSession)
    brands = tasks.select("brand").distinct()
    names = brands.withColumn("phrase", F.lower("brand")).unionByName(brands.join(table.withColumnRenamed("brand", "_b"), F.upper("brand") == F.col("_b")).select("brand", F.lower("phrase").alias("phrase"))).distinct()
    named = dictionary.phrases_in(pages.select(*page, "text"), names, page).select(*page, "brand").distinct().withColumn("named", F.lit(True))
    head, top = F.lower(F.substring("text", 1, 1200)), F.lower(T.compact(F.substring("text", 1, 900)))
    marks = pages.select(*page, any_in(head, packs.START_MARKS).alias("starts"), (any_in(top, packs.SECTION_MARKS) & any_in(top, packs.SECTION_SECOND_MARKS)).alias("opens"))
    rows = tasks.select(*TASK).distinct().join(marks, "filename").join(named, [*page, "brand"], "left")
    begins = rows.where("named and starts").groupBy(*TASK).agg(F.min("page_num").alias("first"))
    ends = rows.where("named is null and opens").join(begins, TASK).where("page_num > first").groupBy(*TASK).agg(F.min("page_num").alias("last"))
    return begins.join(ends, TASK, "left")


def section_texts(tasks: DataFrame, pages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Filename, brand and the text of each task's section; tasks without one are left out."""
    spans = section_pages(tasks, pages, aliases)
    own = pages.select("filename", "page_num", "text").join(spans, "filename").where("page_num >= first and (last is null or page_num < last)")
    said = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))))
    return own.groupBy(*TASK).agg(T.normal_space(F.array_join(F.transform(said, lambda x: x["text"]), "\n")).alias("text")).where("text <> ''")


def rule_extract(sections: DataFrame) -> DataFrame:
    """X: filename, brand, text -> the 12 parameters; blocks are computed once, in a projection of their own."""
    b = extract.blocks(F.col("text"))
    with_blocks = sections.select(*TASK, "text", *[v.alias(f"_{k}") for k, v in b.items()])
    p = extract.parameters(F.col("text"), {k: F.col(f"_{k}") for k in b})
    return with_blocks.select(*TASK, *[v.alias(k) for k, v in p.items()])


def rules_of_sections(tasks: DataFrame, pages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """E4 -> S13f -> S7 -> X: what the rules read from each task's section, for sections that have the labelled layout."""
    return rule_extract(section_texts(tasks, pages, aliases).where(extract.laid_out(F.col("text"))))


def _own_text(sections: DataFrame) -> tuple[Column, Column]:
    """The text that steps are sought in, and where it starts: behind the universal text if the text begins with that."""
    if "universal_text" not in sections.columns:
        return F.col("text"), F.lit(0)
    shared = F.coalesce("universal_text", F.lit(""))
    cut = F.when((shared != "") & F.startswith("text", F.substring(shared, 1, 100)), F.length(shared)).otherwise(0)
    return F.substring("text", cut + 1, F.length("text")), cut


def requirement_rows(sections: DataFrame, drugs: DataFrame | None = None, keys: list[str] = TASK) -> DataFrame:
    """A row for each step requirement of a section, with ``drugs``, the names inside its source, in the dictionary's order.

    Requirements and mentions are intervals of one section's text: an equi-join on the section with the interval
    as its condition. A section has as many requirements as there are step patterns at most, so a mention
    meets no more. Names count where they stand as words of the section.
    """
    text, start = _own_text(sections)
    rows = sections.select(*keys, start.alias("_from"), F.posexplode(extract.requirements(text)).alias("no", "r"))
    rows = rows.select(*keys, "no", "r.count", "r.drug_type", "r.connector", "r.source_text", (F.col("r.start") + F.col("_from")).alias("start"), (F.col("r.end") + F.col("_from")).alias("end"))
    found = dictionary.places(sections.select(*keys, "text"), drugs if drugs is not None else dictionary.drug_dim(sections.sparkSession), keys)
    names = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "ord", F.col("start").alias("_start"), F.col("end").alias("_end"), "phrase")
    inside = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col("_start") >= F.col("start")) & (F.col("_end") <= F.col("end"))
    own = [*keys, "no", "count", "drug_type", "connector", "source_text", "start", "end"]
    met = rows.join(names, inside, "left").groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("phrase").isNotNull(), F.struct("ord", "_start", "phrase")))).alias("m"))
    return met.select(*own, F.transform("m", lambda x: x["phrase"]).alias("drugs"))


def reauth_sentences(text: Column, budget: int = 1500) -> Column:
    """The sentences and lines about reauthorisation, up to the one with which they go beyond ``budget`` characters."""
    about = F.filter(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: any_in(F.lower(s), packs.REAUTH_SENTENCE_WORDS))
    return F.array_join(F.transform(T.prefix_within(about, budget + 1), strip), "\n")


def step_analysis(sections: DataFrame, drugs: DataFrame | None = None, keys: list[str] = TASK) -> DataFrame:
    """P: requirements, mentions, phototherapy, reauthorisation sentences and the combined counts of each section.

    sections: filename, brand, text and, if apart, universal_text. One row a task. Sections without a
    universal text apart that share their text share its analysis.
    """
    table = drugs if drugs is not None else dictionary.drug_dim(sections.sparkSession)
    if "universal_text" in sections.columns:
        return steps_of(sections, table, keys)
    texts = Texts(sections.select(*keys, "text"))
    return texts.seen(texts.rows, lambda rows: steps_of(rows, table, [c for c in rows.columns if c != "text"])).drop("text_no")


def steps_of(sections: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`step_analysis` of each section by itself."""
    need = requirement_rows(sections, table, keys)
    shape = F.struct("no", "count", "drug_type", "drugs", "connector", "source_text")
    needs = need.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(shape)), lambda x: x.dropFields("no")).alias("requirements"))
    found = dictionary.places(sections.select(*keys, "text"), table, keys)
    said = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", F.col("phrase").alias("name"), "classification", "context"))), lambda x: x.dropFields("ord", "start")).alias("drug_mentions"))
    shared = F.length(F.coalesce("universal_text", F.lit(""))) if "universal_text" in sections.columns else F.lit(0)
    rows = sections.select(*keys, shared.alias("_shared"), extract.phototherapy(F.col("text")).alias("photo"), reauth_sentences(F.col("text")).alias("reauth_text"))
    rows = rows.join(needs, keys, "left").join(said, keys, "left")
    rows = rows.withColumns({"requirements": F.coalesce("requirements", F.array().cast(needs.schema["requirements"].dataType)), "drug_mentions": F.coalesce("drug_mentions", F.array().cast(said.schema["drug_mentions"].dataType))})
    rows = rows.withColumn("c", extract.combine(F.col("requirements"), F.size("drug_mentions"), F.col("_shared")))
    return rows.select(*keys, "requirements", "drug_mentions", "reauth_text", "c.*", F.col("photo.mandatory").alias("phototherapy_mandatory"), F.col("photo.in_or").alias("phototherapy_in_or"))
