"""The inference hook (U1-U7) and prompts.

The model call is the caller's: a function from a list of prompts to a list of
answers, of which one can be None (none came) or ``TOO_LARGE``. Everything
around it is DataFrame work: chunks are rows, routes and retries are stages that
run on the rows that are left, and what a call answered is settled before it
is looked at, so no prompt is sent twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions import extract
from policyspark.functions import text as T
from policyspark.functions.score import real_params, text_of
from policyspark.operators import context, dictionary, records
from policyspark.operators.repeats import Texts
from policyspark.operators.stages import first_that_answers, settle

Call = Callable[[list[str]], list[str | None]]
#: What a call answers for a prompt that is too large for it.
TOO_LARGE = "\x00too large"
ANSWER = ", ".join(f"{p} string" for p in packs.PARAMS) + ", reasoning string, estimated_access_score string"
TASK = ["filename", "brand"]
CHUNK = [*TASK, "chunk_no"]
RECORD = [*packs.PARAMS, "reasoning"]
#: Fields of an example that compact prompts cut.
LONG_FIELDS = ["step_therapy_requirements", "reauth_requirements", "quantity_limits"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def prompt(header: str, text: Column, universal: Column | None = None, tree: Column | None = None, about: dict[str, Column] | None = None, closing: str = "") -> Column:
    """Header, facts about the document, shared criteria if any, the text, the decision tree's instruction if any, and a closing line."""
    parts: list[Column | str] = [header]
    if about:
        parts.append("\n\nDOCUMENT INFO:")
        for name, value in about.items():
            parts += [f"\n- {name}: ", F.coalesce(value.cast("string"), F.lit(""))]
    if universal is not None:
        parts.append(F.when(F.coalesce(universal, F.lit("")) != "", F.concat(F.lit("\n\nUNIVERSAL CRITERIA:\n"), universal)).otherwise(""))
    parts += ["\n\nPOLICY TEXT:\n", text]
    if tree is not None:
        parts.append(F.when(F.coalesce(tree, F.lit("")) != "", F.concat(F.lit("\n\nDECISION TREE:\n"), tree)).otherwise(""))
    if closing:
        parts.append(f"\n\n{closing}")
    return _text(*parts)


def few_shot_ids(brand: Column, fixed: int, by_brand: dict[str, int], others: list[int]) -> Column:
    """The fixed example and the brand's own, or else two others."""
    chosen = F.array(F.lit(fixed), *[F.lit(o) for o in others[:2]])
    for b, k in by_brand.items():
        chosen = F.when(F.upper(brand) == b, F.array(F.lit(fixed), F.lit(k))).otherwise(chosen)
    return chosen


def short_example(c: Column, most: int = 80) -> Column:
    """A long field of an example, cut for compact prompts."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def example_text(example: dict[str, Column], compact: bool = False) -> Column:
    """An example's output as JSON, without its reasoning; compact ones have three long fields cut."""
    kept = {k: v for k, v in example.items() if not k.endswith("_reasoning")}
    return F.to_json(F.struct(*[(short_example(v) if compact and k in LONG_FIELDS else v).alias(k) for k, v in kept.items()]))


def examples_text(examples: list[tuple[str, str, dict[str, Column]]], compact: bool = False) -> Column:
    """(description, summary, output) examples, numbered from one; compact ones leave the summary out."""
    parts: list[Column | str] = ["EXAMPLES:\n"]
    for i, (description, summary, output) in enumerate(examples, 1):
        parts += [f"\nExample {i}: {description}\n", *([] if compact else [f"Context: {summary}\n"]), example_text(output, compact), "\n"]
    return _text(*parts)


def full_prompt(examples: Column, task: Column) -> Column:
    """U8: worked examples, if any, before the task's own prompt."""
    return _text(F.when(F.coalesce(examples, F.lit("")) != "", F.concat(examples, F.lit("\n---\n\n"))), task)


def field_hints(fields: dict[str, str], missing: Column | None = None) -> Column:
    """U8: a line of advice for each field, or for each in the array ``missing``, in the order of ``fields``."""
    lines = F.array(*[F.lit(f"- {k}: {v}") if missing is None else F.when(F.array_contains(missing, k), F.lit(f"- {k}: {v}")) for k, v in fields.items()])
    return F.array_join(F.array_compact(lines), "\n")


def keywords_of(brand: Column) -> Column:
    """Keywords of the small model's context: the pack's, the brand and its generic name."""
    own = F.array(F.lower(brand), F.nullif(F.lower(context.generic_of(brand)), F.lit("")))
    return F.array_compact(F.concat(F.array(*[F.lit(w) for w in packs.CHUNK_KEYWORDS]), own))


def small_prompt(hints: Column, text: Column, universal: Column, brand: Column, most: int = 10_000) -> Column:
    """U8: advice for each field, and of universal and own text together the part with the most keywords."""
    both = F.when(F.coalesce(universal, F.lit("")) != "", F.concat(universal, F.lit("\n\n"), text)).otherwise(text)
    return _text(hints, "\n\nPolicy text:\n", T.focused(both, keywords_of(brand), most))


def analysis_block(requirements: Column, branded: Column, generic: Column, mandatory: Column, in_or: Column, confidence: Column, reasoning: Column) -> Column:
    """A step analysis as text: each requirement with its first five drugs and 200 characters of its source, phototherapy, and the counts."""
    drugs = lambda r: F.concat(F.array_join(F.slice(r["drugs"], 1, 5), ", "), F.when(F.size(r["drugs"]) > 5, F.concat(F.lit(" (+"), (F.size(r["drugs"]) - 5).cast("string"), F.lit(" more)"))).otherwise(""))
    source = lambda r: F.when(r["source_text"] != "", F.concat(F.lit('\n   "'), F.translate(F.substring(r["source_text"], 1, 200), "\n", " "), F.lit('"'))).otherwise("")
    lines = F.transform(requirements, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["count"].cast("string"), F.lit(" "), r["drug_type"], F.lit(" ["), r["connector"], F.lit("]: "), drugs(r), source(r)))
    head = F.when(F.size(requirements) > 0, F.concat(F.lit("STEP REQUIREMENTS: "), F.size(requirements).cast("string"), F.lit("\n"), F.array_join(lines, "\n"))).otherwise("STEP REQUIREMENTS: none")
    photo = F.when(mandatory, "mandatory").when(in_or, "one of several options").when(mandatory.isNotNull(), "not required").otherwise("not mentioned")
    value = F.when(mandatory, "Yes").when(mandatory.isNotNull() | in_or, "No").otherwise("N/A")
    why = F.when(reasoning != "", F.concat(F.lit("\nreasoning: "), reasoning)).otherwise("")
    return _text(head, "\nphototherapy: ", photo, "\n\nsteps_through_brands: ", branded, "\nsteps_through_generic: ", generic, "\nstep_through_phototherapy: ", value, "\nconfidence: ", confidence, why)


def with_analysis(chunks: DataFrame, keys: list[str] = CHUNK) -> DataFrame:
    """B13, P: ``chunks`` (text) with ``analysis``, the block of each one's step analysis."""
    table = dictionary.drug_dim(chunks.sparkSession)

    def look(rows: DataFrame) -> DataFrame:
        own = ["text_no"] if "text_no" in rows.columns else keys
        found = context.steps_of(rows, table, own)
        block = analysis_block(*[F.col(c) for c in ("requirements", "branded_steps", "generic_steps", "phototherapy_mandatory", "phototherapy_in_or", "confidence", "reasoning")])
        return rows.join(found.select(*own, block.alias("analysis")), own)

    if "universal_text" in chunks.columns:
        return look(chunks)
    texts = Texts(chunks)
    return texts.seen(texts.rows, look).select(*keys, *[c for c in chunks.columns if c not in keys], "analysis")


def chunk_budgets(overhead: Column, universal: Column, tokens: int = 12000, out: int = 2000) -> tuple[Column, Column]:
    """Characters of a chunk with the universal text before it, and of one without."""
    return T.context_chars(overhead + F.length(universal), tokens, out), T.context_chars(overhead, tokens, out)


def chunk_rows(contexts: DataFrame, overhead: int = 3000, small: tuple[int, int] = (6000, 500), large: tuple[int, int] = (12000, 2000)) -> DataFrame:
    """Filename, brand, chunk_no, chunked, route, universal_text and text of each piece of a task's context.

    contexts: filename, brand, universal_text, text. A context that fits the
    large budget is one chunk, which the small model is asked about first. Else chunk 0 is as
    much as fits beside the universal text, to a line end, for the large model; the rest
    is cut at the context's own marks for the small one, without the universal text.
    """
    shared = F.coalesce("universal_text", F.lit(""))
    with_shared, _ = chunk_budgets(F.lit(overhead), shared, *large)
    _, small_room = chunk_budgets(F.lit(overhead), shared, *small)
    rows = contexts.select(*TASK, shared.alias("universal_text"), F.coalesce("text", F.lit("")).alias("text")).withColumn("room", with_shared)
    rows = rows.withColumn("chunked", F.length("text") > F.col("room")).withColumn("cut", T.line_end_near(F.col("text"), F.col("room")))
    rest = F.substring("text", F.col("cut") + 1, F.length("text"))
    rest = F.when(rest != "", T.marked_sections(rest, packs.CONTEXT_MARK, small_room)).otherwise(F.array().cast("array<string>"))
    pieces = F.when(~F.col("chunked"), F.array("text")).otherwise(F.concat(F.array(F.substring("text", F.lit(1), F.col("cut"))), rest))
    rows = rows.select(*TASK, "universal_text", "chunked", F.posexplode(pieces).alias("chunk_no", "text"))
    first = F.col("chunk_no") == 0
    return rows.select(*CHUNK, "chunked", F.when(F.col("chunked") & first, "large").otherwise("small").alias("route"), F.when(first, F.col("universal_text")).otherwise("").alias("universal_text"), "text")


def infer(tasks: DataFrame, call: Call, keys: list[str] = TASK) -> DataFrame:
    """``prompt`` to ``answer`` for each row, in Arrow batches; ``problem`` says why there is none: too large, or no answer."""
    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema.fields}

    def stage(frames):
        for frame in frames:
            said = call(frame["prompt"].tolist())
            frame = frame[keys].assign(answer=[a if a and a != TOO_LARGE else None for a in said], problem=["too large" if a == TOO_LARGE else None if a else "no answer" for a in said])
            yield frame

    return tasks.select(*keys, "prompt").mapInPandas(stage, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", answer string, problem string")


def parsed(answers: DataFrame, keys: list[str] = TASK) -> DataFrame:
    """Answers as records; those that can't be read have null parameters."""
    return answers.select(*keys, T.json_salvage(F.col("answer"), ANSWER).alias("r")).select(*keys, "r.*")


def readable(record: DataFrame, required: list[str]) -> DataFrame:
    """records in which every required parameter is there."""
    keep = F.lit(True)
    for p in required:
        keep = keep & F.col(p).isNotNull()
    return record.where(keep)


def answered(rows: DataFrame, call: Call, keys: list[str]) -> DataFrame:
    """Records of the rows of ``rows`` (prompt) whose answer can be read."""
    found = settle(infer(rows, call, keys).where("answer is not null"))
    said = found.select(*keys, T.json_salvage(F.col("answer"), ANSWER).alias("r")).where("r is not null")
    return said.select(*keys, *[F.col("r")[c].alias(c) for c in RECORD])


def halves(chunks: DataFrame) -> DataFrame:
    """Each chunk as two, cut at the last line end within 200 characters of the middle, or there; ``path`` tells a left half (a) from a right one (b)."""
    text = F.col("text")
    at = T.line_end_near(text, F.floor(F.length(text) / 2).cast("int"))
    cut = F.array(F.struct(F.lit("a").alias("side"), F.substring(text, F.lit(1), at).alias("half")), F.struct(F.lit("b").alias("side"), F.substring(text, at + 1, F.length(text)).alias("half")))
    rows = chunks.withColumn("_h", F.explode(cut))
    rows = rows.withColumns({"text": F.col("_h.half"), "path": F.concat("path", "_h.side")}).drop("_h")
    return rows.withColumn("universal_text", F.when(F.col("path").endswith("b"), "").otherwise(F.col("universal_text"))) if "universal_text" in chunks.columns else rows


def split_failed(chunks: DataFrame, too_large: Callable[[DataFrame], DataFrame], keys: list[str], most: int = 3, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """What ``chunks`` become when those that ``too_large`` picks are halved, and those given up.

    At most ``most`` further passes, each over the halves of the last pass's failures
    only. A failure of under ``least`` characters, or after the last pass, is given up; it
    is a row of the second frame. ``path`` is the way to a piece; in its order pieces make up the chunk.
    """
    rows = chunks.withColumn("path", F.lit(""))
    kept, lost = [], []
    for depth in range(most + 1):
        failed = settle(too_large(rows).select(*keys, "path").distinct())
        kept.append(rows.join(failed, [*keys, "path"], "left_anti"))
        over = rows.join(failed, [*keys, "path"], "left_semi")
        dead = F.lit(True) if depth == most else F.length("text") < least
        lost.append(over.where(dead))
        if depth == most or failed.isEmpty():
            break
        rows = settle(halves(over.where(~dead)))
    out, gone = kept[0], lost[0]
    for k, g in zip(kept[1:], lost[1:]):
        out, gone = out.unionByName(k), gone.unionByName(g)
    return out, gone


def ask_in_pieces(chunks: DataFrame, prompt_of: Callable[[DataFrame], DataFrame], call: Call, keys: list[str] = CHUNK, most: int = 3, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """Records of all chunks and pieces of chunks that were answered, with ``path``, and the chunks given up as too large.

    ``prompt_of`` adds ``prompt``. Each pass asks only about the halves of what was too large in the one before.
    """
    rows, good, lost = chunks.withColumn("path", F.lit("")), [], []
    keyed = [*keys, "path"]
    for depth in range(most + 1):
        said = settle(infer(prompt_of(rows), call, keyed))
        records_of = said.select(*keyed, T.json_salvage(F.col("answer"), ANSWER).alias("r")).where("r is not null")
        good.append(records_of.select(*keyed, *[F.col("r")[c].alias(c) for c in RECORD]))
        over = rows.join(said.where("problem = 'too large'").select(*keyed), keyed, "left_semi")
        dead = F.lit(True) if depth == most else F.length("text") < least
        lost.append(over.where(dead).select(*keyed, F.length("text").alias("chars")))
        todo = settle(halves(over.where(~dead))) if depth < most else None
        if todo is None or todo.isEmpty():
            break
        rows = todo
    out, gone = good[0], lost[0]
    for g, x in zip(good[1:], lost[1:]):
        out, gone = out.unionByName(g), gone.unionByName(x)
    return out, gone


def extract_chunks(chunks: DataFrame, small: Call, large: Call, small_prompt_of: Callable[[DataFrame], DataFrame], large_prompt_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """U3 -> U1 -> D13: one record for each task of which a chunk was answered, merged over its chunks in order.

    Chunks with the route ``small`` are put to the small model; those that it leaves, and the others,
    to the large one, in pieces where they are too large.
    """
    first = answered(small_prompt_of(chunks.where("route = 'small'")), small, CHUNK)
    left = chunks.join(first.select(*CHUNK), CHUNK, "left_anti")
    second, _ = ask_in_pieces(left, large_prompt_of, large)
    rows = first.withColumn("path", F.lit("")).unionByName(second)
    order = F.row_number().over(Window.partitionBy(*TASK).orderBy("chunk_no", "path")) - 1
    return records.merge_chunks(rows.withColumn("chunk_no", order).drop("path"))


def validation_prompts(found: DataFrame, contexts: DataFrame, header: str) -> DataFrame:
    """A prompt for each record that has a context, showing both."""
    said = F.to_json(F.struct(*packs.PARAMS))
    rows = found.join(contexts.select("filename", "brand", "text"), ["filename", "brand"])
    return rows.select("filename", "brand", F.concat(F.lit(header), F.lit("\n\nEXTRACTED:\n"), said, F.lit("\n\nPOLICY TEXT:\n"), F.col("text")).alias("prompt"))


def validate_all(found: DataFrame, contexts: DataFrame, header: str, call: Call) -> DataFrame:
    """Records corrected by a second look at their source, with ``corrections``, the fields that changed.

    A field that the answer leaves out stays as it was; a record whose answer
    can't be read, or that has no context, stays whole.
    """
    answers = parsed(settle(infer(validation_prompts(found, contexts, header), call))).select("filename", "brand", F.struct(*packs.PARAMS).alias("new"))
    rows = found.join(answers, ["filename", "brand"], "left")
    new = {p: F.coalesce(F.col("new")[p], F.col(p)) for p in packs.PARAMS}
    changed = F.array_compact(F.array(*[F.when(~new[p].eqNullSafe(F.col(p)), F.lit(p)) for p in packs.PARAMS]))
    return rows.select("filename", "brand", *[v.alias(p) for p, v in new.items()], changed.alias("corrections"))


def two_groups(simple: DataFrame, complex_: DataFrame, simple_params: list[str], keys: list[str] = TASK) -> DataFrame:
    """Simple and complex parameters of separate calls, joined; what is missing is NA."""
    a, b = simple.alias("a"), complex_.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.join(b, same, "full_outer")
    own = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    return joined.select(*own, *[F.coalesce(F.col(f"{'a' if p in simple_params else 'b'}.{p}"), F.lit("NA")).alias(p) for p in packs.PARAMS])


def _valid(rows: DataFrame, least: int) -> DataFrame:
    """Rows with at least ``least`` simple parameters of a valid form; others become null."""
    kept = {p: F.when(extract.plain_value(p, F.col(p)), F.col(p)) for p in packs.SIMPLE_PARAMS}
    n = sum((F.col(p).isNotNull().cast("int") for p in kept), F.lit(0))
    return rows.withColumns(kept).where(n >= least)


def extract_two_groups(chunks: DataFrame, small: Call, large: Call, simple_prompt: Callable[[DataFrame], DataFrame], confirm_prompt: Callable[[DataFrame], DataFrame], direct_prompt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parameters of each chunk from two calls, with ``simple_stage`` and ``complex_stage``, who answered.

    Simple parameters: the small model if at least five have a valid form, else
    the large one if any has. Complex ones: the small model on a prompt with the step analysis,
    then the large one on the same, then the large one without it; an answer counts if it has the
    three required parameters. Each stage is asked only about the chunks that are left.
    """
    simple = first_that_answers(chunks, CHUNK, {
        "small": lambda rows: _valid(answered(simple_prompt(rows), small, CHUNK), 5),
        "large": lambda rows: _valid(answered(simple_prompt(rows), large, CHUNK), 1),
    })
    analysed = settle(with_analysis(chunks))
    complex_ = first_that_answers(analysed, CHUNK, {
        "small confirms": lambda rows: readable(answered(confirm_prompt(rows), small, CHUNK), packs.REQUIRED_COMPLEX),
        "large confirms": lambda rows: readable(answered(confirm_prompt(rows), large, CHUNK), packs.REQUIRED_COMPLEX),
        "large": lambda rows: readable(answered(direct_prompt(rows), large, CHUNK), packs.REQUIRED_COMPLEX),
    })
    both = two_groups(simple, complex_, packs.SIMPLE_PARAMS, CHUNK)
    rows = chunks.select(*CHUNK).join(both, CHUNK, "left")
    rows = rows.join(simple.select(*CHUNK, F.col("stage").alias("simple_stage")), CHUNK, "left").join(complex_.select(*CHUNK, F.col("stage").alias("complex_stage"), "reasoning"), CHUNK, "left")
    said = F.when(F.col("complex_stage").isNull(), "Complex extraction failed").otherwise(F.col("reasoning"))
    return rows.select(*CHUNK, *[F.coalesce(F.col(p), F.lit("NA")).alias(p) for p in packs.PARAMS], said.alias("reasoning"), F.coalesce("simple_stage", F.lit("failed")).alias("simple_stage"), F.coalesce("complex_stage", F.lit("failed")).alias("complex_stage"))


def low_yield(record: DataFrame, contexts: DataFrame, most: int, least: int = 5) -> DataFrame:
    """Tasks whose record has under ``least`` real parameters, and whose whole text fits and isn't what was read.

    contexts: filename, brand, text (whole) and focused (what the record was read from).
    """
    n = real_params({p: text_of(F.col(p)) for p in packs.PARAMS})
    few = record.where(n < least).select(*TASK)
    return contexts.join(few, TASK, "left_semi").where((F.length("text") <= most) & ~F.col("text").eqNullSafe(F.col("focused")))


def retry_low_yield(record: DataFrame, contexts: DataFrame, again: Callable[[DataFrame], DataFrame], most: int, least: int = 5) -> DataFrame:
    """Gaps of such records filled from a second pass over the whole text; others stay. ``again`` gets only the contexts of :func:`low_yield`."""
    second = again(low_yield(record, contexts, most, least))
    return records.fill_gaps(record.select(*TASK, *packs.PARAMS), second)


def with_fallback(tasks: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """U4: each task's record of the first stage that has one, at last the defaults, with ``stage``; and findings about those.

    ``rules``: what rules read from a task, if anything. A record of theirs with all
    parameters needs no stage; other records are merged with it, the defaults too.
    """
    cols = [*TASK, *packs.PARAMS]
    known = {"rules": lambda rows: readable(rules.select(*cols).join(rows.select(*TASK), TASK, "left_semi"), packs.PARAMS)} if rules is not None else {}
    tried = known | {name: (lambda rows, stage=stage: stage(rows).select(*cols)) for name, stage in stages.items()}
    tried["defaults"] = lambda rows: records.with_defaults(rows.select(*TASK).distinct())
    found = first_that_answers(tasks, TASK, tried)
    flagged = found.where("stage = 'defaults'").select(*TASK, F.lit("all stages failed, defaults used").alias("message"))
    if rules is not None:
        part = rules.select(*cols)
        merged = records.rules_over_model(part, found).join(found.select(*TASK, "stage"), TASK)
        found = merged.unionByName(found.join(part.select(*TASK), TASK, "left_anti").select(*cols, "stage"))
    return found.select(*cols, "stage"), flagged
