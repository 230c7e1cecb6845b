"""Context of a task from its pages at page, paragraph or sentence level (S13h-S13o).

``pages``: filename, page_num (from 0), text; ``tasks``: filename, brand. Every
piece is a row with its place, so tiers are filters, windows and anti joins;
texts are put together once, at the end, one document's pieces at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions import text as T
from policyspark.functions.normalize import any_in, strip
from policyspark.operators.context import TASK, document_types, generic_of, preferred_status, scored_pages, settled_tasks, task_pages, universal_boundary
from policyspark.operators.repeats import Texts, sent
from policyspark.operators.stages import settle

PLACE = [*TASK, "page_num"]


def _any_like(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def _named(low: Column) -> Column:
    """Whether the task's brand or its generic is in the text."""
    generic = generic_of(F.col("brand"))
    return F.contains(low, F.lower("brand")) | ((generic != "") & F.contains(low, generic))


def _study(c: Column) -> Column:
    return T.is_literature(c, F.col("brand"), generic_of(F.col("brand")))


def _joined(mark: str, text: str, order: list[str], glue: str = "\n\n") -> Column:
    """One text of a group's pieces, each under its mark, in order."""
    piece = F.struct(*order, F.concat(F.expr(mark), F.lit("\n"), F.col(text)).alias("piece"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), glue)


def _kinds(pages: DataFrame, kinds: DataFrame | None, texts: Texts | None = None) -> DataFrame:
    """The types of the documents, settled, unless the caller has them already: they take a scan of all texts."""
    return sent(settle(document_types(pages, texts=texts)) if kinds is None else kinds)


def _brands(tasks: DataFrame) -> DataFrame:
    return tasks.select("brand").distinct()


def _universal(rows: DataFrame) -> DataFrame:
    late = _any_like(F.lower("text"), [*packs.UNIVERSAL_PATTERNS, *packs.TIER_PATTERNS])
    return rows.withColumns({"own": strip(F.col("text")), "late": late})


def universal_pages(pages: DataFrame, kinds: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """S13k: filename, page_num, text of the pages that hold for all drugs of a multi-drug document.

    The pages before the first drug's section, and later ones under a universal
    header or a rule for non-preferred drugs. Documents of other types have none.
    """
    texts = texts or Texts(pages)
    return _universal_places(pages, _kinds(pages, kinds, texts), texts).select("filename", "page_num", F.col("own").alias("text"))


def _universal_places(pages: DataFrame, kinds: DataFrame, texts: Texts) -> DataFrame:
    multi = kinds.where("document_type = 'multi-drug'").select("filename")
    rows = texts.rows.join(multi, "filename", "left_semi").join(sent(settle(universal_boundary(pages))), "filename")
    return texts.seen(rows, _universal).where("(page_num < boundary and own <> '') or (page_num >= boundary and late)")


def _paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of at least 30 characters of pages that are no studies, with the signals that are looked for."""
    paras = rows.where(~_study(F.col("text"))).select("*", F.posexplode(T.paragraphs(F.col("text"))).alias("ord", "para")).where(F.length("para") >= 30)
    low = F.lower("para")
    words = [w for ws in packs.PARAM_KEYWORDS.values() for w in ws]
    signal, named, param = T.has_signal(low), _named(low), any_in(low, words)
    good = ((signal & named) | (signal & param) | (named & param)) & T.on_indication(low) & ~((F.length("para") > 300) & _study(F.col("para")))
    return paras.select("*", good.alias("good"), signal.alias("signal"))


def paragraph_rows(tasks: DataFrame, pages: DataFrame, texts: Texts | None = None) -> DataFrame:
    """S13i: paragraphs with two of signal, brand and parameter words that aren't about another indication."""
    return _good_paragraphs(tasks, pages, texts or Texts(pages, tasks)).select(*PLACE, "ord", "para")


def _good_paragraphs(tasks: DataFrame, pages: DataFrame, texts: Texts) -> DataFrame:
    tasks = settled_tasks(tasks)
    return texts.seen(tasks.join(texts.rows, "filename"), _paragraphs, _brands(tasks)).where("good")


def _section(tasks: DataFrame, pages: DataFrame, kinds: DataFrame | None, texts: Texts) -> tuple[DataFrame, DataFrame]:
    """Rows of whole pages and of paragraphs that :func:`section_rows` is made of."""
    tasks = settled_tasks(tasks)
    rows = tasks.join(texts.rows, "filename").join(_kinds(pages, kinds, texts).select("filename", "document_type"), "filename")
    own = texts.seen(rows.where("document_type = 'single-drug'"), lambda r: r.withColumn("para", strip(F.col("text"))).where("para <> ''")).withColumn("ord", F.lit(0))
    paras = texts.seen(rows.where("document_type <> 'single-drug'"), _paragraphs, _brands(tasks))
    some = paras.groupBy(F.col("filename").alias("_f"), F.col("brand").alias("_b")).agg(F.max("good").alias("some"))
    same = F.col("filename").eqNullSafe(F.col("_f")) & F.col("brand").eqNullSafe(F.col("_b"))
    kept = paras.join(sent(settle(some)), same).where(F.when(F.col("some"), F.col("good")).otherwise(F.col("signal")))
    return own, kept


def section_rows(tasks: DataFrame, pages: DataFrame, kinds: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """S13l: the paragraphs of :func:`paragraph_rows`, or where a task has none, those with the signal.

    Single-drug documents keep all their pages, as one paragraph each.
    """
    own, kept = _section(tasks, pages, kinds, texts or Texts(pages, tasks))
    return own.select(*PLACE, "ord", "para").unionByName(kept.select(*PLACE, "ord", "para"))


def _snippets(rows: DataFrame) -> DataFrame:
    """Sentences with a parameter's words, with their neighbours, of pages with the brand or the signal that are no studies."""
    rows = rows.where((_named(F.lower("text")) | T.has_signal(F.lower("text"))) & ~_study(F.col("text")))
    sents = rows.withColumn("all", T.sentences(F.col("text"))).select("*", F.posexplode("all").alias("sent", "s"))
    low = F.lower("s")
    hits = F.array_compact(F.array(*[F.when(any_in(low, ws), F.struct(F.lit(k).alias("ord"), F.lit(p).alias("param"))) for k, (p, ws) in enumerate(packs.PARAM_KEYWORDS.items())]))
    first = F.greatest(F.col("sent"), F.lit(1))
    around = F.array_join(F.slice("all", first, F.col("sent") + 2 - first + 1), " ")
    return sents.where(T.on_indication(low)).select(*rows.columns, "sent", around.alias("snippet"), F.explode(hits).alias("h")).select(*rows.columns, "sent", "snippet", "h.*")


def snippet_rows(tasks: DataFrame, pages: DataFrame, section: DataFrame, per_param: int = 5, kinds: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """S13m, E3, E6, F6: sentences with a parameter's words from pages outside the section, with their neighbours.

    Single-drug documents and those of at most ten pages have none. Of snippets
    that begin with the same 100 characters the first in the order of page,
    parameter and sentence counts; then each parameter keeps its first five.
    """
    texts, tasks = texts or Texts(pages, tasks), settled_tasks(tasks)
    long = _kinds(pages, kinds, texts).where("document_type <> 'single-drug' and n_pages > 10").select("filename")
    rows = tasks.join(texts.rows, "filename").join(long, "filename", "left_semi").join(section.select(*PLACE), PLACE, "left_anti")
    found = texts.seen(rows, _snippets, _brands(tasks))
    found = found.groupBy(*TASK, "param", "ord", "sent", "snippet").agg(F.min("page_num").alias("page_num"))  # of a snippet that is said again only the first page can count
    once = F.row_number().over(Window.partitionBy(*TASK, F.substring("snippet", 1, 100)).orderBy("page_num", "ord", "sent"))
    found = found.withColumn("n", once).where("n = 1")
    place = F.row_number().over(Window.partitionBy(*TASK, "param").orderBy("page_num", "sent"))
    return found.withColumn("n", place).where(F.col("n") <= per_param).select(*PLACE, "param", "sent", "snippet", "ord", "n")


def page_tags(tasks: DataFrame, pages: DataFrame, least: float = 3.0, kinds: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """S13h: each page's tag, score and whether it is part of the context.

    Relevant pages; pages with universal words; pages right beside a relevant
    one; the first five pages of a multi-drug document. In documents of over 50
    pages a relevant page must name the disease or the brand. Short and
    single-drug documents are taken whole; where under two relevant pages
    remain, every page with a score is.
    """
    texts = texts or Texts(pages, tasks)
    rows = _tags(tasks, pages, least, kinds, texts)
    return texts.seen(rows, lambda r: r.select("*")).select(*PLACE, "text", "document_type", "n_pages", "tag", "score", "included")


def _scored(tasks: DataFrame, pages: DataFrame, texts: Texts) -> DataFrame:
    """Each task's pages with ``relevance`` and the categories that their tags depend on; a text is scored once for each brand."""
    marks = [F.col("relevance"), *[F.array_contains("categories", c).alias(c) for c in ("disease", "target_brand", "universal")]]
    brands = _brands(tasks)
    if texts.few is None:
        return scored_pages(tasks, pages).select(*PLACE, "text", *marks)

    def look(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("text_no").cast("string").alias("filename"), F.lit(0).alias("page_num"), "brand", "text")
        return scored_pages(named, named.drop("brand").distinct()).select(F.col("filename").cast("int").alias("text_no"), "brand", *marks)

    return texts.seen(tasks.join(texts.rows, "filename"), look, brands).select(*PLACE, "text_no", "relevance", "disease", "target_brand", "universal")


def _tags(tasks: DataFrame, pages: DataFrame, least: float, kinds: DataFrame | None, texts: Texts) -> DataFrame:
    """:func:`page_tags` with each page's text or number, which the windows carry along."""
    whole = Window.partitionBy(*TASK)
    near = whole.orderBy("page_num")
    rows = _scored(settled_tasks(tasks), pages, texts)
    own = "text" if "text" in rows.columns else "text_no"
    rows = rows.join(_kinds(pages, kinds, texts).select("filename", "document_type", "n_pages"), "filename")
    firm = (F.col("n_pages") <= 50) | F.col("disease") | F.col("target_brand")
    rows = rows.withColumn("hit", F.col("relevance") >= least).withColumn("kept", F.col("hit") & firm)
    rows = rows.withColumn("universal", ~F.col("hit") & F.col("universal")).drop("disease", "target_brand")
    beside = lambda c: F.coalesce(F.lag(c).over(near), F.lit(False)) | F.coalesce(F.lead(c).over(near), F.lit(False))
    plain = ~F.col("hit") & ~F.col("universal")
    rows = rows.withColumn("was_beside", plain & beside("hit")).withColumn("beside", F.col("was_beside") & beside("kept"))
    tag = F.when(F.col("kept"), "relevant").when(F.col("universal"), "universal").when(F.col("beside"), "context").when(plain & ~F.col("was_beside") & (F.col("document_type") == "multi-drug") & (F.col("page_num") < 5), "preamble").otherwise("irrelevant")
    score = F.when(F.col("hit") & ~F.col("kept"), 0.0).otherwise(F.col("relevance"))
    rows = rows.select(*PLACE, own, "document_type", "n_pages", tag.alias("tag"), score.alias("score"))
    rows = rows.withColumn("few", F.count(F.when(F.col("tag") == "relevant", 1)).over(whole) < 2)
    taken = F.when((F.col("document_type") == "single-drug") | (F.col("n_pages") <= 15), True).when(F.col("few"), (F.col("score") > 0) | F.col("tag").isin("preamble", "universal")).otherwise(F.col("tag") != "irrelevant")
    return rows.withColumn("included", taken).drop("few")


def _renewing(low: Column) -> tuple[Column, Column]:
    """Whether a page is about reauthorisation, and whether it names the disease."""
    return any_in(low, packs.REAUTH_WORDS), any_in(low, packs.PAGE_KEYWORDS["disease"][0])


def renewal_rows(tags: DataFrame) -> DataFrame:
    """S13n: pages about reauthorisation, of the context or that name the disease, the context's first."""
    again, disease = _renewing(F.lower("text"))
    return tags.where(again & (F.col("included") | disease)).select(*PLACE, (~F.col("included")).cast("int").alias("turn"), strip(F.col("text")).alias("text"))


def limit_rows(tags: DataFrame) -> DataFrame:
    """S13n: pages of the context that are labelled as quantity limits."""
    return tags.where(F.col("included") & any_in(F.lower("text"), packs.LIMIT_PHRASES)).select(*PLACE, strip(F.col("text")).alias("text"))


#: Pieces from which a task's context is put together in a task of Spark's of its own: its text is some MB, and files are written from many rows at once.
PIECES = 20_000


def _library(texts: Texts) -> DataFrame:
    """One row: of each distinct text, by number, the whole page and its paragraphs, as they are and as :func:`T.clean_piece` leaves them."""
    page, paras = strip(F.col("text")), T.paragraphs(F.col("text"))
    own = texts.few.select("text_no", page.alias("page"), T.clean_piece(page).alias("clean_page"), paras.alias("paras")).withColumn("clean_paras", F.transform("paras", T.clean_piece))
    return settle(own.agg(F.array_sort(F.collect_list(F.struct("text_no", "page", "clean_page", "paras", "clean_paras"))).alias("library")))


def _held(rows: DataFrame, keys: list[str], name: str, *parts: str | Column) -> DataFrame:
    """A row for each of ``keys`` with its pieces as one array, in order."""
    return settle(rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(name)))


def _marked(pieces: Column, mark: Callable[[Column], Column], said: Callable[[Column], Column], glue: str = "") -> Column:
    """Each piece behind its mark; pieces without a text are left out."""
    return F.array_compact(F.transform(pieces, lambda x: F.concat(mark(x), F.lit(glue), said(x))))


def _whole(pieces: Column, glue: str = "") -> Column:
    """Cleaned pieces as one text; only the last can end in blanks."""
    said = lambda a: F.concat(F.array_join(F.slice(a, F.lit(1), F.size(a) - 1), glue), F.when(F.size(a) > 1, glue).otherwise(""), strip(F.get(a, F.size(a) - 1)))
    return F.get(F.transform(F.array(pieces), lambda a: F.when(F.size(a) > 0, said(a)).otherwise("")), F.lit(0))


def _apart(rows: DataFrame, n_pieces: Column) -> DataFrame:
    """Settled ``rows`` dealt out one by one, the more tasks the more pieces they have."""
    n, pieces = rows.agg(F.count("*"), F.coalesce(F.sum(n_pieces.cast("long")), F.lit(0))).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(n, max(parts, pieces // PIECES))))


def context_package(tasks: DataFrame, pages: DataFrame, level: str = "sentence") -> DataFrame:
    """S13o: one context for each task with pages, at ``level``: page, paragraph or sentence.

    filename, brand, document_type, preferred_status, total_pages, pages_used,
    universal_text, section_text, reauthorization_text, quantity_limit_text,
    full_text (cleaned).

    A task's pieces are gathered as places, with their text's number if the distinct texts are few; then the library
    of those goes to every task and texts are put together row by row, at the end. They are cleaned piece by piece.
    """
    if level not in ("page", "paragraph", "sentence"):
        raise ValueError(f"level {level!r}: page, paragraph or sentence are known")
    texts = Texts(pages, tasks)
    few = texts.few is not None
    ref = lambda name: F.col("text_no" if few else name).alias("p")  # noqa: E731  what a piece's text is found by
    found = lambda x, name: F.element_at("library", x["p"] + 1)[name]
    page, clean_page = ((lambda x: found(x, "page")), (lambda x: found(x, "clean_page"))) if few else ((lambda x: x["p"]), (lambda x: T.clean_piece(x["p"])))
    para, clean_para = ((lambda x: F.get(found(x, "paras"), x["ord"])), (lambda x: F.get(found(x, "clean_paras"), x["ord"]))) if few else (page, clean_page)
    number = lambda x: (x["page_num"] + 1).cast("string")
    mark = lambda head: lambda x: F.concat(F.lit(head), number(x), F.lit("]"))
    text_of = lambda pieces, head, said: F.array_join(_marked(pieces, mark(head), said, "\n"), "\n\n")
    nothing = F.array().cast("array<string>")

    kinds = _kinds(pages, None, texts)
    about = kinds.select("filename", "document_type", F.col("n_pages").alias("total_pages"))
    tasks = settle(tasks.select(*TASK).distinct().join(about.select("filename"), "filename", "left_semi"))
    status = preferred_status(sent(tasks).join(pages.select("filename", "page_num", "text"), "filename"))
    universal = _held(_universal_places(pages, kinds, texts).select("filename", "page_num", ref("own")), ["filename"], "shared", "page_num", "p")
    rows = tasks.join(about, "filename").join(status, TASK).join(universal, "filename", "left")
    columns = {"universal_text": text_of(F.col("shared"), "[Universal | Page ", page), "reauthorization_text": F.lit(""), "quantity_limit_text": F.lit("")}
    clean_shared, some_shared = _marked(F.col("shared"), mark("[Universal | Page "), clean_page), F.size("shared") > 0
    pages_of = lambda pieces: F.array_distinct(F.transform(pieces, lambda x: x["page_num"]))
    if level == "page":
        again, disease = _renewing(F.lower("text"))
        flags = {"own": strip(F.col("text")), "again": again, "disease": disease, "limit": any_in(F.lower("text"), packs.LIMIT_PHRASES)}
        tags = texts.seen(_tags(tasks, pages, 3.0, kinds, texts), lambda r: r.withColumns(flags))
        tags = tags.withColumns({"again": F.coalesce(F.col("again") & (F.col("included") | F.col("disease")), F.lit(False)), "limit": F.coalesce("limit", F.lit(False))}).where("included or again")
        own = _held(tags.select(*PLACE, ref("own"), "tag", "included", "again", "limit"), TASK, "own", "page_num", "p", "tag", "included", "again", "limit")
        some = lambda test: F.filter("own", test)
        taken = some(lambda x: x["included"])
        renewing = F.concat(some(lambda x: x["again"] & x["included"]), some(lambda x: x["again"] & ~x["included"]))
        columns |= {
            "section_text": text_of(some(lambda x: x["included"] & x["tag"].isin("relevant", "context")), "[Page ", page),
            "reauthorization_text": text_of(renewing, "[Page ", page),
            "quantity_limit_text": text_of(some(lambda x: x["included"] & x["limit"]), "[Page ", page),
            "full_text": _whole(_marked(taken, lambda x: F.concat(F.lit("[Page "), number(x), F.lit(" | Tag: "), x["tag"], F.lit("]")), clean_page), "---\n\n"),
        }
        n_used, rows = F.size(taken), rows.join(own, TASK, "left")
    else:
        if level == "paragraph":
            head, section = "[Page ", _good_paragraphs(tasks, pages, texts).select(*PLACE, "ord", ref("para"))
        else:
            head, (whole, parts) = "[PsO Section | Page ", _section(tasks, pages, kinds, texts)
            section = settle(whole.select(*PLACE, "ord", ref("para")).unionByName(parts.select(*PLACE, "ord", ref("para"))))
            single = F.col("document_type") == "single-drug"
            para, clean_para = [lambda x, a=a, b=b: F.when(single, a(x)).otherwise(b(x)) for a, b in ((page, para), (clean_page, clean_para))]
        rows = rows.join(_held(section, TASK, "own", "page_num", "ord", "p"), TASK, "left")
        n_used, shown, third = F.size(pages_of("own")), F.lit(False), F.lit("")
        if level == "sentence":
            snippets = snippet_rows(tasks, pages, section, kinds=kinds, texts=texts)
            line = snippets.groupBy(*TASK, "param", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "snippet"))), lambda x: F.concat(F.lit("  - "), x["snippet"])), "\n").alias("lines"))
            rows = rows.join(line.groupBy(*TASK).agg(_joined("concat('[', upper(replace(param, '_', ' ')), ']')", "lines", ["ord"]).alias("snippet_text")), TASK, "left")
            shown = F.coalesce("snippet_text", F.lit("")) != ""
            third = T.clean(F.concat(F.lit("[PARAMETER-SPECIFIC SNIPPETS]\n"), F.col("snippet_text")))
            small = single | (F.col("total_pages") <= 10)
            n_used = F.size(F.array_union(pages_of("own"), F.when(small, F.array().cast("array<int>")).otherwise(pages_of("shared"))))
            n_used = F.when((n_used == 0) & small, F.col("total_pages")).otherwise(n_used)  # small documents without a section count as read whole
        between = lambda test: F.when(test, F.array(F.lit("---\n\n"))).otherwise(nothing)
        some_own = F.size("own") > 0
        whole_text = F.concat(clean_shared, between(some_shared & some_own), _marked(F.col("own"), mark(head), clean_para), between((some_shared | some_own) & shown), F.when(shown, F.array(third)).otherwise(nothing))
        columns |= {"section_text": text_of(F.col("own"), head, para), "full_text": _whole(whole_text)}

    none = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("shared", "own")}
    rows = _apart(settle(rows.withColumns(none)), F.size("shared") + F.size("own"))
    if few:
        rows = rows.crossJoin(F.broadcast(_library(texts)))
    order = ["universal_text", "section_text", "reauthorization_text", "quantity_limit_text", "full_text"]
    return rows.select(*TASK, "document_type", "preferred_status", "total_pages", n_used.cast("long").alias("pages_used"), *[columns[c].alias(c) for c in order])
