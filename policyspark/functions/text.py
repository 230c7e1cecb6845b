"""Text shaping (S1-S12) and text predicates (S13, P3, P4); all Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions.normalize import any_in, strip

BLANKS = r"\n\s*\n(\s*\n)+"


def clean(c: Column) -> Column:
    """Strip lines, squeeze blanks, drop footers and page numbers, close spaced hyphens."""
    return strip(_cleaned(c))


def _cleaned(c: Column) -> Column:
    lines = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    steps = [(BLANKS, "\n\n"), (r"[ \t]{2,}", " "), (r"(?m)^(Last Update:.*|Effective:.*Page.*|Page\s*\d+\s*of\s*\d+.*)$", ""), (r"(?m)^\s*\d{1,3}\s*$", ""), (r"(\w) - (\w)", "$1-$2"), (r"(\w)- (\w)", "$1-$2"), (r"(\w) -(\w)", "$1-$2"), (BLANKS, "\n\n")]
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, lines)


def clean_piece(c: Column) -> Column:
    """What :func:`clean` makes of a piece between a line with a mark in brackets and an empty line with the next mark or rule behind it, with the line ends on both sides.

    No pattern reaches over a mark, so a text of marked pieces can be cleaned piece by piece.
    """
    out = _cleaned(F.concat(F.lit("[]\n"), c, F.lit("\n\n[")))
    return F.substring(out, F.lit(3), F.length(out) - 3)


def _nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(c: Column, least: int = 20) -> Column:
    """S3: sentences of at least ``least`` characters."""
    flat = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    parts = F.split(flat, r"(?<=[.;])\s+(?=[A-Z0-9(])")
    items = F.flatten(F.transform(parts, lambda p: F.split(p, r"(?:^|\n)\s*\d+[.)]\s+")))
    return F.filter(F.transform(items, strip), lambda s: F.length(s) >= least)


def packed(parts: Column, most: Column | int, glue: str) -> Column:
    """Neighbouring parts joined while they stay within ``most`` characters; no part is cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    joined = lambda s, p: F.concat(s["now"], F.lit(glue), p)
    return F.aggregate(
        parts,
        start,
        lambda s, p: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), p.alias("now")))
        .when(F.length(joined(s, p)) <= most, F.struct(s["done"].alias("done"), joined(s, p).alias("now")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), p.alias("now"))),
        lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))),
    )


def grouped(parts: Column, least: int) -> Column:
    """Parts joined by spaces until a group has at least ``least`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    joined = lambda s, p: F.when(s["now"] == "", p).otherwise(F.concat(s["now"], F.lit(" "), p))
    return F.aggregate(
        parts,
        start,
        lambda s, p: F.when(s["n"] + F.length(p) >= least, F.struct(F.concat(s["done"], F.array(joined(s, p))).alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))).otherwise(
            F.struct(s["done"].alias("done"), joined(s, p).alias("now"), (s["n"] + F.length(p)).alias("n"))
        ),
        lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))),
    )


def paragraphs(c: Column) -> Column:
    """By blank lines, else by list marks, else groups of sentences of about 500 characters."""
    by_blank = F.split(c, r"\n\s*\n")
    by_mark = _nonblank(F.split(c, r"\n(?=\d+[.)]\s)|\n(?=[a-zA-Z][.)]\s)|\n(?=•\s)|\n(?=[-–]\s)"))
    one = F.element_at(by_mark, 1)
    return F.when(F.size(by_blank) > 1, _nonblank(by_blank)).when((F.size(by_mark) == 1) & (F.length(one) > 1000), grouped(sentences(one), 500)).otherwise(by_mark)


def sliding_chunks(c: Column, size: int = 3000, overlap: int = 250) -> Column:
    """Windows of ``size`` characters that overlap."""
    step = size - overlap
    n = F.when(F.length(c) <= size, 1).otherwise(F.ceil((F.length(c) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(c, k * step + 1, F.lit(size)))


def hard_cut(parts: Column, most: Column) -> Column:
    """Parts, with those longer than ``most`` characters cut into pieces of that length."""
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / most).cast("int") - 1), lambda k: F.substring(p, k * most + 1, most)))))


def marked_sections(c: Column, marks: str, most: Column | int) -> Column:
    """Pieces of at most ``most`` characters, in order.

    Parts begin where ``marks`` (a regex) does, or without two such parts are
    paragraphs; a part that is too long is taken apart into its paragraphs.
    Neighbouring parts are joined as they are while they fit; what is still too
    long is cut. Only blank parts and the line ends between paragraphs are lost.
    """
    most = F.lit(most) if isinstance(most, int) else most
    solid = lambda parts: F.filter(parts, lambda p: strip(p) != "")
    paras = lambda t: solid(F.split(t, r"\n{2,}"))
    marked = solid(F.split(c, f"(?={marks})"))
    parts = F.when(F.size(marked) > 1, marked).otherwise(paras(c))
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(paras(p))))
    pieces = hard_cut(packed(parts, most, ""), most)
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.substring(c, F.lit(1), most)))


def line_end_near(c: Column, at: Column, reach: int = 200) -> Column:
    """Characters before the last line end within ``reach`` of ``at``; ``at`` itself if there is none."""
    low = F.greatest(at - reach, F.lit(0))
    window = F.substring(c, low + 1, at + reach - low)
    back = F.instr(F.reverse(window), "\n")
    found = low + F.length(window) - back
    return F.when((back > 0) & (found > 0), found).otherwise(at)


def focused(c: Column, keywords: Column, most: int = 10_000, size: int = 3000, overlap: int = 250, best: int = 8) -> Column:
    """E5, U8: a long text's chunks with the most keywords, each with its neighbours, in order, cut at ``most`` characters; its first three if none has one."""
    chunks = sliding_chunks(c, size, overlap)
    hits = lambda x: F.size(F.filter(keywords, lambda w: F.contains(F.lower(x), w)))
    ranked = F.array_sort(F.filter(F.transform(chunks, lambda x, i: F.struct((-hits(x)).alias("s"), i.alias("i"))), lambda x: x["s"] < 0))
    near = F.flatten(F.transform(F.slice(ranked, 1, best), lambda x: F.array(x["i"] - 1, x["i"], x["i"] + 1)))
    chosen = F.when(F.size(ranked) > 0, near).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    numbers = F.array_sort(F.array_distinct(F.filter(chosen, lambda i: (i >= 0) & (i < F.size(chunks)))))
    text = F.array_join(F.transform(numbers, lambda i: F.element_at(chunks, i + 1)), "\n\n")
    return F.when(F.length(c) <= most, c).otherwise(F.substring(text, 1, most))


def compact(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normal_space(c: Column) -> Column:
    x = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(x, r"\n\s+", "\n"), r"\s+\n", "\n"))


def block_between(c: Column, start: str, ends: list[str]) -> Column:
    """What stands between a label and the first of the later labels; null if nothing does."""
    found = F.regexp_extract(c, rf"(?is){start}\s*(.*?)(?={'|'.join(ends)}|\z)", 1)
    value = normal_space(F.regexp_replace(normal_space(found), r"(?i)^(Information|Restrictions|Duration|Criteria)\s+", ""))
    return F.when(c.rlike(rf"(?is){start}") & ~value.isin("", "-", "—"), value)


def context_chars(overhead: Column, tokens: float, out: float, ratio: float = 1.4) -> Column:
    """Characters of context that a request has room for."""
    room = (F.lit(float(tokens - out)) - overhead / F.lit(ratio)) * F.lit(0.95) * F.lit(ratio)
    return F.greatest(F.lit(500), room.cast("int"))


def window_around(c: Column, names: list[Column], size: int = 24000, small: int = 10000) -> Column:
    """From the first place where one of ``names`` stands at a line's start, else anywhere; else the head."""
    at = F.coalesce(
        *[F.nullif(F.regexp_instr(F.lower(c), F.concat(F.lit(r"(?m)^\s*\Q"), F.lower(n), F.lit(r"\E"))), F.lit(0)) for n in names],
        *[F.nullif(F.instr(F.lower(c), F.lower(n)), F.lit(0)) for n in names],
        F.lit(1),
    )
    return F.when(F.length(c) <= small, c).otherwise(F.substring(c, at, F.lit(size)))


def places_of(low: Column, word: Column) -> Column:
    """Places (from 0) of all occurrences of a literal in a text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    parts = F.split(low, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")))
    ends = F.aggregate(parts, start, lambda a, p: F.struct((a["at"] + F.length(p) + F.length(word)).alias("at"), F.array_append(a["found"], a["at"] + F.length(p)).alias("found")), lambda a: a["found"])
    return F.when(F.contains(low, word), F.slice(ends, 1, F.size(ends) - 1)).otherwise(F.array().cast("array<int>"))


def brand_section(c: Column, names: list[Column], size: int = 24000, small: int = 10000) -> Column:
    """The part of a long text that is about a brand; a text of at most ``small`` characters stays whole.

    In this order: where an approval phrase names the brand, 500 characters
    before it; where a criteria mark has a name within 3000 characters, 500
    before it; where a name has a word of criteria within 1000 characters, 1000
    before it; at a section mark; at the head. Names that are '' are skipped.
    """
    low = F.lower(c)
    none = F.lit(None).cast("int")
    before = lambda at, back: F.when(at.isNotNull(), F.greatest(at - back, F.lit(0)))
    phrases = [F.when(n != "", F.nullif(F.instr(low, F.concat(F.lit(p.split("{}")[0]), n, F.lit(p.split("{}")[1]))), F.lit(0)) - 1) for n in names for p in packs.APPROVAL_PHRASES]

    def near_name(at: Column) -> Column:
        back, ahead = F.substring(low, before(at, 3000) + 1, F.least(at, F.lit(3000))), F.substring(low, at + 1, F.lit(3000))
        return reduce(lambda a, b: a | b, [(n != "") & (F.contains(back, n) | F.contains(ahead, n)) for n in names])

    def near_criteria(at: Column, n: Column) -> Column:
        from_ = before(at, 1000)
        return any_in(F.substring(low, from_ + 1, at - from_ + F.length(n) + 1000), packs.NEAR_WORDS)

    marks = [F.get(F.filter(places_of(low, F.lit(m)), near_name), F.lit(0)) for m in packs.CRITERIA_MARKS]
    named = [F.when(n != "", F.get(F.filter(places_of(low, n), lambda at, n=n: near_criteria(at, n)), F.lit(0))).otherwise(none) for n in names]
    first = lambda xs: F.coalesce(*xs)
    start = F.coalesce(before(first(phrases), 500), before(first(marks), 500), before(first(named), 1000), F.nullif(F.instr(low, "[pso section"), F.lit(0)) - 1, F.lit(0))
    return F.when(F.length(c) <= small, c).otherwise(F.substring(c, start + 1, F.lit(size)))


def prefix_within(parts: Column, budget: Column | int) -> Column:
    """Parts until their running length reaches the budget; the one that crosses it stays."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, lambda s, p: F.when(s["n"] < budget, F.struct(F.concat(s["kept"], F.array(p)).alias("kept"), (s["n"] + F.length(p)).alias("n"))).otherwise(s), lambda s: s["kept"])


def snippet(c: Column, words: list[str], budget: Column | int, brand: Column | None = None) -> Column:
    """Sentences and lines with one of the words or the brand, up to a budget, else the text's head; without words the head."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    head = F.substring(c, F.lit(1), budget)
    if not words:
        return head
    named = lambda low: F.contains(low, F.lower(brand)) if brand is not None else F.lit(False)
    about = F.filter(F.split(c, r"(?<=[.!?])\s+|\n"), lambda s: any_in(F.lower(s), words) | named(F.lower(s)))
    kept = prefix_within(about, budget)
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, strip), "\n")).otherwise(head)


def param_snippet(c: Column, param: str, budget: Column | int, brand: Column) -> Column:
    """The snippet of a simple parameter, by its own keywords."""
    return snippet(c, packs.PARAM_KEYWORDS[packs.SNIPPET_KEYWORDS[param]] if param in packs.SNIPPET_KEYWORDS else [], budget, brand)


def safe_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\-.]", "_")


def json_salvage(c: Column, schema: str) -> Column:
    """JSON as it is, from a fenced block, or from the first brace to the last; else null."""
    tries = [c, F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)\{.*\}", 0)]
    parsed = [F.from_json(F.when(F.trim(t).startswith("{"), t), schema, {"mode": "PERMISSIVE", "primitivesAsString": "true"}) for t in tries]
    good = lambda p: F.when(~F.to_json(p).isin("{}"), p)  # noqa: E731  what can't be parsed has only nulls
    return F.coalesce(*[good(p) for p in parsed])


def has_signal(low: Column) -> Column:
    return any_in(low, packs.SIGNAL_WORDS) | low.rlike(packs.SIGNAL_PATTERN)


def on_indication(low: Column) -> Column:
    return ~any_in(low, packs.OTHER_INDICATIONS) | has_signal(low)


def count_all(low: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(low, F.lit(p)) for p in patterns), F.lit(0))


def is_literature(c: Column, brand: Column | None = None, generic: Column | None = None) -> Column:
    """Many study signals and few of policy, unless the brand is named."""
    low = F.lower(c)
    n, m = count_all(low, packs.STUDY_PATTERNS), count_all(low, packs.POLICY_PATTERNS)
    found = ((n > 10) & (m <= 2)) | ((n > 5) & (m == 0)) | ((n >= 8) & (n / F.greatest(m, F.lit(1)) > 5))
    named = F.lit(False)
    for name in (brand, generic):
        if name is not None:
            named = named | F.coalesce((name != "") & F.contains(low, F.lower(name)), F.lit(False))
    return found & ~named


def relevance(low: Column, brand: Column, generic: Column, keywords: dict | None = None) -> tuple[Column, Column]:
    """S13d: additive score of a page, and the categories it matched."""
    keywords = keywords or packs.PAGE_KEYWORDS
    target = F.contains(low, F.lower(brand)) | F.coalesce((generic != "") & F.contains(low, F.lower(generic)), F.lit(False))
    hits = {"target_brand": (target, packs.TARGET_WEIGHT)}
    for name, (words, weight) in keywords.items():
        if name == "other_brands":
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) & (F.lit(w) != F.lower(brand)) & (F.lit(w) != F.coalesce(F.lower(generic), F.lit(""))) for w in words])
        else:
            hit = any_in(low, words)
        hits[name] = (hit, weight)
    points = sum((F.when(h, F.lit(w)).otherwise(F.lit(0.0)) for h, w in hits.values()), F.lit(0.0))
    return points, F.array_compact(F.array(*[F.when(h, n) for n, (h, _) in sorted(hits.items())]))


def connector(c: Column) -> Column:
    """The connector that rules a block of text."""
    low = F.lower(c)
    ors, ands = F.regexp_count(low, F.lit(r"\bor\b")), F.regexp_count(low, F.lit(r"\band\b"))
    return F.when(any_in(low, packs.AND_MARKERS), "AND").when(any_in(low, packs.OR_MARKERS), "OR").when(ors > ands, "OR").when(ands > 0, "AND").otherwise("OR")


def count_word(c: Column) -> Column:
    """One to five, as word or digit; anything else is one."""
    low = F.lower(strip(c))
    found = F.when(F.lit(False), F.lit(0))
    for n, w in enumerate(["one", "two", "three", "four", "five"], 1):
        found = found.when(low.isin(w, str(n)), n)
    return found.otherwise(1)
