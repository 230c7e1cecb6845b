"""DuckDB SQL for the queries: written from the rules' wording, not from the Spark plans."""

from __future__ import annotations

from policyspark import packs
from policyspark.functions import extract
from policyspark.sources.fixtures import LARGE_OMITS, LARGE_UNREADABLE, MODEL_RULES, PAGE_WORDING, SECTION_BRANDS, SECTION_WORDING, SMALL_FAILS, SMALL_OMITS, TOO_LARGE_CHARS, TOO_LARGE_WORDS, WORDING

P = packs.PARAMS


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def picked(key: str) -> str:
    return ", ".join(f"([{', '.join(lit(v) for v in vs)}])[1 + ({key} // {p}) % {len(vs)}] AS {name}" for name, (p, vs) in WORDING.items())


def raw(shift: int = 0, name: str = "raw") -> str:
    return f"""{name} AS (SELECT filename, brand, CASE WHEN k % 11 <> 0 THEN (k % 120 - 5)::INT END AS estimated_access_score, {picked(f'(k + {shift})')}
  FROM (SELECT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 25) AS brand, min(o_orderkey) AS k FROM orders GROUP BY 1, 2))"""


def number(c: str) -> str:
    words = " ".join(f"WHEN contains({c}, {lit(w)}) THEN {n}" for w, n in packs.NUMBER_WORDS.items())
    return f"CASE WHEN regexp_matches({c}, '^[0-9]+') THEN regexp_extract({c}, '^([0-9]+)', 1)::INT {words} END"


def n_yes_no(c: str) -> str:
    low = f"lower({c})"
    return f"CASE WHEN {low} IN {among(packs.NA_FORMS)} THEN 'NA' WHEN {low} IN {among(packs.NO_FORMS)} THEN 'No' WHEN {low} IN {among(packs.YES_FORMS)} OR {has(low, packs.YES_PHRASES)} THEN 'Yes' WHEN {has(low, packs.NO_PHRASES)} THEN 'No' WHEN length({c}) <= 5 THEN {c} ELSE 'Yes' END"


def n_steps(c: str) -> str:
    return f"CASE WHEN lower({c}) IN {among(packs.NA_FORMS)} THEN 'NA' ELSE coalesce(({number(f'lower({c})')})::VARCHAR, 'NA') END"


def n_duration(c: str) -> str:
    low, n = f"lower({c})", number(f"lower({c})")
    return f"""CASE WHEN {low} IN {among(packs.NA_FORMS)} OR {has(low, packs.OPEN_ENDED)} OR ({n}) IS NULL THEN 'NA'
  WHEN contains({low}, 'year') THEN (({n}) * 12)::VARCHAR WHEN contains({low}, 'week') THEN greatest(1, ({n}) // 4)::VARCHAR
  WHEN contains({low}, 'day') THEN greatest(1, ({n}) // 30)::VARCHAR WHEN ({n}) <= 36 OR ({n}) > 400 THEN ({n})::VARCHAR ELSE greatest(1, ({n}) // 30)::VARCHAR END"""


def n_age(c: str) -> str:
    low = f"lower({c})"
    rules = " ".join(f"WHEN regexp_matches({low}, {lit(p)}) THEN '>=' || regexp_extract({low}, {lit(p)}, 1)" for p in packs.AGE_PATTERNS)
    return f"CASE WHEN {low} IN {among(packs.NA_FORMS)} THEN 'NA' WHEN {has(low, packs.AGELESS)} THEN 'No' {rules} WHEN contains({low}, 'adult') AND NOT contains({low}, 'pediatric') THEN '>=18' WHEN regexp_full_match({c}, '[0-9]+') THEN '>=' || {c} ELSE {c} END"


def n_specialist(c: str) -> str:
    low = f"lower({c})"
    known = "list_filter([" + ", ".join(f"CASE WHEN contains({low}, {lit(s)}) THEN {lit(s.capitalize())} END" for s in packs.SPECIALISTS) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN {low} IN {among(packs.NA_FORMS)} OR {has(low, packs.ANY_SPECIALIST)} THEN 'NA' WHEN len({known}) > 0 THEN array_to_string({known}, ', ') WHEN contains({low}, 'specialist') OR contains({low}, 'board-certified') THEN 'Specialist' ELSE {c} END"


def n_therapy(c: str) -> str:
    low = f"lower({c})"
    return f"CASE WHEN {low} IN {among(packs.NA_FORMS)} THEN 'NA' WHEN {low} IN {among(packs.STEP_NO)} THEN 'No' WHEN {low} IN {among(packs.STEP_YES)} THEN 'Yes' WHEN length({c}) > 20 THEN {c} WHEN {has(low, packs.STEP_WORDS)} THEN 'Yes' ELSE {c} END"


def n_quantity(c: str) -> str:
    low = f"lower({c})"
    d, q = has(low, packs.DOSAGE_WORDS), has(low, packs.LIMIT_WORDS)
    return f"CASE WHEN {low} IN {among(packs.NA_FORMS)} THEN 'NA' WHEN {low} IN {among(packs.LIMIT_NO)} THEN 'No' WHEN {low} IN ('yes', 'true') THEN 'Yes' WHEN {d} AND NOT {q} THEN 'NA' WHEN {q} THEN 'Yes' WHEN length({c}) <= 5 THEN {n_yes_no(c)} WHEN length({c}) > 20 THEN 'Yes' ELSE {c} END"


def n_text(c: str) -> str:
    return f"CASE WHEN lower({c}) IN {among(packs.NA_FORMS)} THEN 'NA' ELSE {c} END"


NORMAL = dict(zip(P, [n_age, n_therapy, n_steps, n_steps, n_yes_no, n_yes_no, n_quantity, n_specialist, n_duration, n_duration, n_yes_no, n_text]))


def norm(src: str = "raw", name: str = "norm", keep: str = "filename, brand") -> str:
    return f"{name} AS (SELECT {keep}, " + ", ".join(f"{f(f'trim({p})')} AS {p}" for p, f in NORMAL.items()) + f" FROM {src})"


def int_of(c: str) -> str:
    """int(float(text)) where the text is a number."""
    return f"CASE WHEN {c} IN ('NA', 'N/A', 'No', 'Unspecified', '') THEN NULL ELSE trunc(try_cast({c} AS DOUBLE))::INT END"


def label() -> str:
    return "CASE brand " + " ".join(f"WHEN '{b}' THEN {a.strip('>=') if a != 'No' else 18}" for b, a in packs.LABEL_AGE.items()) + " ELSE 18 END"


def age_pts() -> str:
    n = "try_cast(nullif(regexp_extract(age, '([0-9]+)', 1), '') AS INT)"
    return f"CASE WHEN age IN ('No', '') THEN 10 WHEN {n} IS NULL THEN 8 WHEN {n} = {label()} THEN 8 WHEN {n} > {label()} THEN 3 ELSE 10 END"


def text_pts() -> str:
    t, low = "reauth_requirements", "lower(reauth_requirements)"
    return f"CASE WHEN {t} IN ('NA', 'N/A', 'No', '', 'Unspecified') THEN 10 WHEN regexp_matches({low}, {lit('|'.join(packs.STRICT_REAUTH))}) THEN 3 WHEN regexp_matches({low}, {lit('|'.join(packs.LENIENT_REAUTH))}) THEN 7 ELSE 5 END"


def steps_pts(c: str, pts) -> str:
    return f"CASE WHEN {c} IN ('NA', 'N/A', 'No', '', '0') OR coalesce({int_of(c)}, 0) <= 0 THEN {pts[0]} WHEN ({int_of(c)}) = 1 THEN {pts[1]} WHEN ({int_of(c)}) = 2 THEN {pts[2]} ELSE {pts[3]} END"


def scored(src: str = "norm", name: str = "scored", keep: str = "filename, brand") -> str:
    real = " + ".join(f"({p} NOT IN ('NA', 'N/A', '', 'None', 'No'))::INT" for p in P)
    return f"""{name}_a AS (SELECT *, coalesce({int_of('steps_through_brands')}, 0) AS b, coalesce({int_of('steps_through_generic')}, 0) AS g0,
    {int_of('initial_auth_duration')} AS m, {int_of('reauth_duration')} AS again, {age_pts()} AS ap, {text_pts()} AS rp, {real} AS n_real,
    (step_through_phototherapy = 'Yes')::INT AS ph, (tb_test_required IN ('Yes', 'Y'))::INT AS tb, (quantity_limits = 'Yes')::INT AS ql,
    (specialist_types NOT IN ('NA', 'N/A', 'No', ''))::INT AS sp, (reauth_required = 'Yes')::INT AS rq FROM {src}),
  {name}_b AS (SELECT *, CASE WHEN step_therapy_requirements NOT IN ('No', 'NA', 'N/A', '', 'None', 'Yes') AND length(step_therapy_requirements) > 20 AND b + g0 = 0 THEN 1 ELSE g0 END AS g,
    ph + tb + ql + sp + rq + (age NOT IN ('No', '', 'NA'))::INT + coalesce((m < 6)::INT, 0) AS held FROM {name}_a),
  {name}_c AS (SELECT *, (CASE WHEN b + g <= 0 THEN 90 WHEN b + g = 1 THEN CASE WHEN b = 0 THEN 50 ELSE 40 END WHEN b + g = 2 THEN CASE WHEN b <= 1 THEN 30 ELSE 20 END WHEN b + g = 3 THEN 15 WHEN b + g = 4 THEN 10 ELSE 5 END
    + CASE WHEN m IS NULL THEN -2 * rq WHEN m >= 12 THEN 5 WHEN m >= 6 THEN 2 WHEN m >= 3 THEN 0 ELSE -5 END
    + CASE WHEN rq = 0 THEN 0 WHEN again >= 12 THEN -2 WHEN again <= 3 THEN -8 ELSE -5 END
    + CASE WHEN rp <= 3 THEN -5 WHEN rp <= 5 THEN -3 ELSE 0 END + CASE WHEN ap <= 3 THEN -5 ELSE 0 END - 8 * ph - 3 * tb - 3 * ql - 5 * sp)::DOUBLE
    * CASE WHEN held >= 6 THEN 0.6::DOUBLE WHEN held = 5 THEN 0.7::DOUBLE WHEN held = 4 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS layered FROM {name}_b),
  {name}_d AS (SELECT *, least(100, greatest(0, round_even(CASE WHEN b >= 2 THEN least(layered, 50) ELSE layered END + 25, 0))) AS pts FROM {name}_c),
  {name} AS (SELECT {keep}, {', '.join(P)}, b, g, (CASE WHEN n_real < 2 THEN 25 WHEN b >= 4 AND g >= 3 THEN 0 WHEN b + g >= 7 THEN 0 WHEN b >= 4 THEN 25
    WHEN pts <= 12 THEN 0 WHEN pts <= 37 THEN 25 WHEN pts <= 62 THEN 50 WHEN pts <= 87 THEN 75 ELSE 100 END)::INT AS access_score FROM {name}_d)"""


def v_of(p: str) -> str:
    low, c = f"lower({p})", p
    head = f"CASE WHEN {c} IS NULL OR {low} IN ('', 'none') THEN 'NA' "
    if p == "tb_test_required":
        body = f"WHEN {low} IN ('yes', 'y', 'true', '1', 'required') THEN 'Y' WHEN {low} IN ('no', 'n', 'false', '0', 'not required') THEN 'No' WHEN {low} IN ('na', 'n/a', 'not applicable', 'not mentioned') THEN 'NA'"
    elif p == "reauth_required":
        body = f"WHEN {low} IN ('yes', 'y', 'true', '1') THEN 'Yes' WHEN {low} IN ('no', 'n', 'false', '0') THEN 'No' WHEN {low} IN ('na', 'n/a', 'not applicable') THEN 'NA'"
    elif p == "step_through_phototherapy":
        body = f"WHEN {low} IN ('yes', 'y', 'true', '1', 'required') THEN 'Yes' WHEN {low} IN ('no', 'n', 'false', '0', 'not required') THEN 'No' WHEN {low} IN ('na', 'n/a', 'not applicable', 'not mentioned') THEN 'N/A'"
    elif p == "quantity_limits":
        body = f"WHEN {low} IN ('na', 'n/a', 'not applicable', 'not mentioned', 'unspecified', 'not specified') THEN 'NA' WHEN {low} IN ('no', 'n', 'false', '0', 'no quantity limit', 'no quantity limits') THEN 'No' WHEN {low} IN ('yes', 'y', 'true', '1') THEN 'Yes'"
    elif p.startswith("steps_"):
        n = f"trunc(try_cast({c} AS DOUBLE))::INT"
        body = f"WHEN {low} IN ('na', 'n/a', 'no', '0', 'not applicable', 'not mentioned') OR {n} = 0 THEN 'NA' WHEN {n} IS NOT NULL THEN ({n})::VARCHAR"
    elif p.endswith("_duration"):
        body = f"WHEN {low} IN ('na', 'n/a', 'not mentioned') THEN 'NA' WHEN {low} IN ('unspecified', 'not specified', 'unknown') THEN 'Unspecified' WHEN regexp_matches({c}, '[0-9]') THEN regexp_extract({c}, '([0-9]+)', 1)"
    elif p == "specialist_types":
        body = f"WHEN {low} IN ('na', 'n/a', 'no', 'not specified', 'not mentioned') THEN 'NA'"
    elif p == "age":
        body = f"WHEN {low} IN ('not specified', 'na', 'n/a', 'not mentioned') THEN 'No' WHEN contains({low}, 'fda') THEN 'FDA labelled age'"
    else:
        body = ""
    return f"{head}{body} ELSE {c} END AS {p}"


def ruled(src: str = "scored", name: str = "ruled") -> str:
    rest = [p for p in P if p not in ("reauth_required", "reauth_duration", "steps_through_brands", "steps_through_generic", "quantity_limits")]
    return f"""{name}_v AS (SELECT filename, brand, access_score, {', '.join(v_of(p) for p in P)} FROM {src}),
  {name}_r AS (SELECT *, reauth_required = 'Yes' AND reauth_duration = 'NA' AS r1,
    (regexp_full_match(reauth_duration, '[0-9]+') OR reauth_requirements NOT IN ('NA', 'N/A', '', 'No')) AND reauth_required <> 'Yes' AS r2,
    quantity_limits NOT IN ('NA', 'No', 'Yes', 'N/A', '') AND (contains(lower(quantity_limits), 'dosage') OR contains(lower(quantity_limits), 'dosing')) AND NOT contains(lower(quantity_limits), 'quantity limit') AS r5 FROM {name}_v),
  {name} AS (SELECT filename, upper(brand) AS brand, access_score, {', '.join(rest)},
    CASE WHEN r2 THEN 'Yes' ELSE reauth_required END AS reauth_required,
    CASE WHEN r1 OR (r2 AND reauth_duration = 'NA') THEN 'Unspecified' ELSE reauth_duration END AS reauth_duration,
    CASE WHEN steps_through_brands IN ('0', 'No') THEN 'NA' ELSE steps_through_brands END AS steps_through_brands,
    CASE WHEN steps_through_generic IN ('0', 'No') THEN 'NA' ELSE steps_through_generic END AS steps_through_generic,
    CASE WHEN r5 THEN 'NA' ELSE quantity_limits END AS quantity_limits,
    array_to_string(list_filter([CASE WHEN r1 THEN 'R1' END, CASE WHEN r2 THEN 'R2' END, CASE WHEN steps_through_brands = '0' THEN 'R3' END, CASE WHEN steps_through_generic = '0' THEN 'R4' END, CASE WHEN r5 THEN 'R5' END, CASE WHEN brand <> upper(brand) THEN 'R6b' END, CASE WHEN r2 AND reauth_duration = 'NA' THEN 'R7' END], lambda x: x IS NOT NULL), ',') AS violations FROM {name}_r)"""


RESULTS = f"WITH {raw()}, {norm()}, {scored()}, {ruled()} "
SCORED = f"WITH {raw()}, {norm()}, {scored()} "
RECORDS = f"""records AS (SELECT filename, brand, pass_name, provider, {picked('w')} FROM (SELECT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 25) AS brand,
  CASE WHEN o_orderkey % 4 = 0 THEN 'validate' ELSE 'extract' END AS pass_name, CASE o_orderkey % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'groq-optimized' ELSE '' END AS provider, min(o_orderkey) AS w FROM orders GROUP BY 1, 2, 3, 4))"""
TASKS = """tasks AS (SELECT doc_id * 2 AS row_no, doc_id::VARCHAR AS filename, 'Brand#' || (1 + doc_id % 25) AS brand FROM documents
  UNION ALL SELECT doc_id * 2 + 1, doc_id::VARCHAR, 'Brand#' || (1 + (doc_id + 7) % 25) FROM documents WHERE doc_id % 3 = 0)"""
PAGES = """pages_ AS (SELECT doc_id::VARCHAR AS filename, (unnest(range(len(s))))::INT AS page_num, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""
#: Keywords of the derived pages, whose vocabulary is not that of the default pack.
PAGE_PACK = {"disease": (["license"], 3.0), "other_brands": (["mail"], 0.5), "secondary": (["the", "that"], 1.0), "universal": (["token"], 2.0)}
SCORED_PAGES = f"""{TASKS}, {PAGES}, sp AS (SELECT t.filename, t.brand, p.page_num, p.text, """ + " + ".join(
    [f"CASE WHEN contains(lower(p.text), lower(t.brand)) THEN {packs.TARGET_WEIGHT}::DOUBLE ELSE 0 END"] + [f"CASE WHEN {has('lower(p.text)', ws)} THEN {w}::DOUBLE ELSE 0 END" for ws, w in PAGE_PACK.values()]
) + " AS relevance FROM (SELECT DISTINCT filename, brand FROM tasks) t JOIN pages_ p USING (filename))"


def unpivot(src: str) -> str:
    return " UNION ALL ".join(f"SELECT filename, brand, '{p}' AS \"column\", {p} AS value FROM {src}" for p in P)


def consistency() -> str:
    match = among(packs.MUST_MATCH)
    return RESULTS + f""", long AS ({unpivot('ruled')}), agg AS (SELECT filename, "column", count(*) AS n, count(DISTINCT value) AS n_values,
      max(CASE WHEN regexp_full_match(value, '[0-9]+') THEN value::INT END) - min(CASE WHEN regexp_full_match(value, '[0-9]+') THEN value::INT END) AS spread
      FROM long WHERE "column" IN {among([*packs.MUST_MATCH, *packs.MUST_BE_NEAR])} GROUP BY 1, 2)
    SELECT filename, "column", n_values, CASE WHEN "column" NOT IN {match} THEN spread END AS spread FROM agg
    WHERE n >= 2 AND CASE WHEN "column" IN {match} THEN n_values > 1 ELSE spread > 6 END"""


def expected_values() -> str:
    rows = [f"('{b}', '{c}', '{v}', {p}::DOUBLE)" for b, cs in derived_expectations().items() for c, vs in cs.items() for v, p in vs.items()]
    return "expected(brand, \"column\", value, pct) AS (VALUES " + ", ".join(rows) + ")"


def derived_expectations() -> dict:
    """The pack's expectations, for brands that the derived tables have."""
    return {"BRAND#1": packs.EXPECTED["STELARA"], "BRAND#2": packs.EXPECTED["TREMFYA"]}


def components() -> str:
    need = "reauth_required"
    pts = {
        "Steps Brands": ("steps_through_brands", steps_pts("steps_through_brands", (20, 12, 6, 0)), 20),
        "Steps Generic": ("steps_through_generic", steps_pts("steps_through_generic", (15, 10, 5, 0)), 15),
        "Phototherapy": ("step_through_phototherapy", "CASE WHEN step_through_phototherapy = 'Yes' THEN 0 ELSE 5 END", 5),
        "TB Test": ("tb_test_required", "CASE WHEN tb_test_required IN ('Yes', 'Y') THEN 0 ELSE 5 END", 5),
        "Age": ("age", age_pts(), 10),
        "Init Auth Duration": ("initial_auth_duration", f"CASE WHEN ({int_of('initial_auth_duration')}) IS NULL THEN 8 WHEN ({int_of('initial_auth_duration')}) >= 12 THEN 15 WHEN ({int_of('initial_auth_duration')}) >= 6 THEN 10 WHEN ({int_of('initial_auth_duration')}) >= 3 THEN 5 ELSE 3 END", 15),
        "Reauth Required": (need, f"CASE WHEN {need} <> 'Yes' THEN 10 WHEN ({int_of('reauth_duration')}) IS NOT NULL THEN 5 ELSE 3 END", 10),
        "Quantity Limits": ("quantity_limits", "CASE WHEN quantity_limits IN ('No', 'NA', 'N/A', '') THEN 5 ELSE 0 END", 5),
        "Specialist": ("specialist_types", "CASE WHEN specialist_types IN ('NA', 'N/A', 'No', '') THEN 5 ELSE 0 END", 5),
        "Reauth Reqs": ("reauth_requirements", text_pts(), 10),
    }
    return SCORED + " UNION ALL ".join(f"SELECT filename, brand, '{n}' AS component, {c} AS value, ({e})::INT AS points, {m}::INT AS max FROM scored" for n, (c, e, m) in pts.items())


def merged(src: str) -> str:
    """The record of each task over the chunk records of ``src``."""
    def na(c):
        return f"({c} IS NULL OR lower(trim({c})) IN {among(packs.MERGE_NA_FORMS)})"

    out = []
    for p in P:
        good = f"FILTER (WHERE NOT {na(p)})"
        first, longest = f"arg_min({p}, chunk_no) {good}", f"(list({p} ORDER BY length({p}) DESC, chunk_no) {good})[1]"
        num = f"FILTER (WHERE NOT {na(p)} AND regexp_full_match(trim({p}), '[0-9]+'))"
        yes = f"bool_or(lower(trim({p})) = 'yes') {good}"
        if p in ("step_through_phototherapy", "tb_test_required", "reauth_required"):
            e = f"CASE WHEN count(*) {good} > 1 AND {yes} THEN 'Yes' ELSE {first} END"
        elif p.startswith("steps_"):
            e = f"CASE WHEN count(*) {good} <= 1 THEN {first} ELSE coalesce((max(try_cast({p} AS INT)) {num})::VARCHAR, {longest}) END"
        elif p.endswith("_duration"):
            e = f"CASE WHEN count(*) {good} <= 1 THEN {first} ELSE coalesce((min(try_cast({p} AS INT)) {num})::VARCHAR, {longest}) END"
        elif p == "step_therapy_requirements":
            e = f"CASE WHEN count(*) {good} <= 1 THEN {first} ELSE coalesce((list({p} ORDER BY length({p}) DESC, chunk_no) FILTER (WHERE NOT {na(p)} AND length({p}) > 20))[1], CASE WHEN {yes} THEN 'Yes' END, {first}) END"
        else:
            e = f"CASE WHEN count(*) {good} <= 1 THEN {first} ELSE {longest} END"
        out.append(f"CASE WHEN count(*) = 1 THEN min({p}) ELSE coalesce({e}, 'NA') END AS {p}")
    return f"SELECT filename, brand, count(*) AS n_chunks, {', '.join(out)}, string_agg(reasoning, ' | ' ORDER BY chunk_no) AS reasoning FROM {src} GROUP BY 1, 2"


def merge() -> str:
    return f"""WITH c AS (SELECT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 25) AS brand, row_number() OVER (PARTITION BY o_custkey, 1 + o_orderkey % 25 ORDER BY o_orderkey, l_linenumber) - 1 AS chunk_no,
      'r' || (o_orderkey + l_linenumber) AS reasoning, {picked('(o_orderkey + l_linenumber)')} FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l JOIN orders o ON l.l_orderkey = o.o_orderkey)
    {merged('c')}"""


def room(over: str, tokens: int, out: int) -> str:
    return f"greatest(500, trunc(({tokens - out}::DOUBLE - ({over}) / 1.4::DOUBLE) * 0.95::DOUBLE * 1.4::DOUBLE)::INT)"


def near_line_end(text: str, at: str) -> str:
    """Characters before the last line end within 200 of ``at``, or ``at``."""
    low = f"greatest({at} - 200, 0)"
    window = f"substring({text}, ({low} + 1)::INT, ({at} + 200 - {low})::INT)"
    back = f"strpos(reverse({window}), chr(10))"
    return f"(CASE WHEN {back} > 0 AND {low} + length({window}) - {back} > 0 THEN {low} + length({window}) - {back} ELSE {at} END)::INT"


def pieces(text: str, most: str, mark: str = packs.CONTEXT_MARK) -> str:
    """The splitter's pieces of a text, as a list."""
    solid = lambda e: f"[p FOR p IN {e} IF trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '']"
    paras = lambda t: solid(f"string_split(regexp_replace({t}, '\\n{{2,}}', chr(1), 'g'), chr(1))")
    marked = solid(f"string_split(regexp_replace({text}, {lit('(' + mark + ')')}, chr(1) || '\\1', 'g'), chr(1))")
    parts = f"CASE WHEN len({marked}) > 1 THEN {marked} ELSE {paras(text)} END"
    small = f"flatten([CASE WHEN length(q) <= {most} THEN [q] ELSE {paras('q')} END FOR q IN {parts}])"
    joined = f"string_split(list_reduce({small}, lambda acc, x: CASE WHEN length(string_split(acc, chr(1))[-1]) + length(x) > {most} THEN acc || chr(1) || x ELSE acc || x END), chr(1))"
    hard = f"flatten([CASE WHEN length(z) <= {most} THEN [z] ELSE [substring(z, (i * {most} + 1)::INT, ({most})::INT) FOR i IN range(ceil(length(z) / ({most})::DOUBLE)::BIGINT)] END FOR z IN {joined}])"
    return f"CASE WHEN len({small}) > 0 THEN {hard} ELSE [substring({text}, 1, ({most})::INT)] END"


def chunks() -> str:
    """cx: contexts of the derived sections, ck: their chunks."""
    nl = "chr(10)"
    return f"""{sections()}, cx0 AS (SELECT filename, substring(filename, 2)::INT AS k, string_agg('[Page ' || (page_num + 1) || ']' || {nl} || text, {nl} || {nl} ORDER BY page_num) AS text FROM gp WHERE page_num <= substring(filename, 2)::INT % 45 GROUP BY ALL),
  cx AS (SELECT filename, unnest(['STELARA', 'Acitretin']) AS brand, CASE WHEN k % 3 = 0 THEN repeat('All requests need a diagnosis. ', 1 + k % 7) ELSE '' END AS u, text FROM cx0),
  cr AS (SELECT *, {room('3500 + length(u)', 12000, 2000)} AS most FROM cx), cc AS (SELECT *, length(text) > most AS chunked, {near_line_end('text', 'most')} AS cut FROM cr),
  cp AS (SELECT filename, brand, u, chunked, text, cut, substring(text, cut + 1) AS rest FROM cc),
  cl AS (SELECT filename, brand, u, chunked, CASE WHEN NOT chunked THEN [text] WHEN rest = '' THEN [substring(text, 1, cut)] ELSE [substring(text, 1, cut)] || {pieces('rest', room('3500', 6000, 500))} END AS l FROM cp),
  ck AS (SELECT filename, brand, (j - 1)::INT AS chunk_no, chunked, CASE WHEN chunked AND j = 1 THEN 'large' ELSE 'small' END AS route, CASE WHEN j = 1 THEN u ELSE '' END AS u, l[j] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM cl))"""


def model_says(text: str, large: bool, omits: str | None) -> str:
    """The fields that a stand-in for a model reads from a text."""
    out = []
    for p in P:
        cases = " ".join(f"WHEN contains({text}, {lit(w)}) THEN {lit(b if large else a)}" for q, w, a, b in MODEL_RULES if q == p)
        e = f"length({text}) || ' characters of policy text'" if p == "step_therapy_requirements" else f"CASE {cases} ELSE 'NA' END" if cases else "'NA'"
        if p == "steps_through_brands" and omits:
            e = f"CASE WHEN contains({text}, {lit(omits)}) THEN NULL ELSE {e} END"
        out.append(f"{e} AS {p}")
    return ", ".join(out) + f", 'read ' || length({text}) AS reasoning"


TOO_LARGE = f"(contains(text, '{TOO_LARGE_WORDS}') AND length(text) > {TOO_LARGE_CHARS})"
LARGE_READS = f"(NOT {TOO_LARGE} AND NOT contains(text, '{LARGE_UNREADABLE}'))"


def halved(src: str, keys: str, over: str, least: int = 500, most: int = 3) -> str:
    """Rows of ``src`` (keys, text) and the pieces that those ``over`` the limit become, with path and depth."""
    at = near_line_end("text", "length(text) // 2")
    return f"""(SELECT {keys}, '' AS path, 0 AS depth, text FROM {src} UNION ALL SELECT {keys}, path || side, depth + 1, CASE side WHEN 'a' THEN substring(text, 1, {at}) ELSE substring(text, {at} + 1) END
    FROM (SELECT *, unnest(['a', 'b']) AS side FROM hv) WHERE {over} AND depth < {most} AND length(text) >= {least})"""


def chunk_answers() -> str:
    """ma: each task's record merged over its chunks' answers."""
    return f"""sm AS (SELECT filename, brand, chunk_no, '' AS path, {model_says('t', False, SMALL_OMITS)} FROM (SELECT *, CASE WHEN u <> '' THEN u || chr(10) || chr(10) || text ELSE text END AS t FROM ck WHERE route = 'small') WHERE NOT contains(t, '{SMALL_FAILS}')),
  lf AS (SELECT * FROM ck ANTI JOIN sm USING (filename, brand, chunk_no)), hv AS {halved('lf', 'filename, brand, chunk_no', TOO_LARGE)},
  lg AS (SELECT filename, brand, chunk_no, path, {model_says('text', True, None)} FROM hv WHERE {LARGE_READS}),
  an AS (SELECT * RENAME (chunk_no AS piece), row_number() OVER (PARTITION BY filename, brand ORDER BY chunk_no, path) - 1 AS chunk_no FROM (SELECT * FROM sm UNION ALL SELECT * FROM lg)), ma AS ({merged('an')})"""


def two_group_answers() -> str:
    forms = {"tb_test_required": "IN ('Y', 'No', 'NA')", "reauth_required": "IN ('Yes', 'No', 'NA')", "initial_auth_duration": None, "reauth_duration": None}
    ok = lambda p: f"(regexp_full_match({p}, '[0-9]+') OR {p} IN ('NA', 'Unspecified', 'No'))" if p.endswith("duration") else f"({p} {forms.get(p, '<> ' + lit(''))})"
    S, C = packs.SIMPLE_PARAMS, [p for p in P if p not in packs.SIMPLE_PARAMS]
    valid = lambda src, least: f"SELECT filename, brand, chunk_no, {', '.join(f'CASE WHEN {ok(p)} THEN {p} END AS {p}' for p in S)} FROM {src} WHERE {' + '.join(f'{ok(p)}::INT' for p in S)} >= {least}"
    K = "filename, brand, chunk_no"
    small, large = f"NOT contains(text, '{SMALL_FAILS}')", LARGE_READS
    return f"""WITH RECURSIVE {chunks()}, a1 AS (SELECT {K}, {model_says('text', False, SMALL_OMITS)} FROM ck WHERE {small}), a2 AS (SELECT {K}, {model_says('text', True, None)} FROM ck WHERE {large}), a3 AS (SELECT {K}, {model_says('text', True, LARGE_OMITS)} FROM ck WHERE {large}),
  s1 AS ({valid('a1', 5)}), s2 AS (SELECT * FROM ({valid('a2', 1)}) ANTI JOIN s1 USING ({K})), si AS (SELECT *, 'small' AS simple_stage FROM s1 UNION ALL SELECT *, 'large' FROM s2),
  c1 AS (SELECT * FROM a1 WHERE steps_through_brands IS NOT NULL), c2 AS (SELECT * FROM a3 ANTI JOIN c1 USING ({K}) WHERE steps_through_brands IS NOT NULL), c3 AS (SELECT * FROM a2 ANTI JOIN c1 USING ({K}) ANTI JOIN c2 USING ({K})),
  co AS (SELECT *, 'small confirms' AS complex_stage FROM c1 UNION ALL SELECT *, 'large confirms' FROM c2 UNION ALL SELECT *, 'large' FROM c3)
  SELECT {K}, {', '.join(f"coalesce(si.{p}, 'NA') AS {p}" for p in S)}, {', '.join(f"coalesce(co.{p}, 'NA') AS {p}" for p in C)}, coalesce(co.reasoning, 'Complex extraction failed') AS reasoning, coalesce(simple_stage, 'failed') AS simple_stage, coalesce(complex_stage, 'failed') AS complex_stage
  FROM ck LEFT JOIN si USING ({K}) LEFT JOIN co USING ({K})"""


def fallback() -> str:
    """Who answers a task first, and that record with what the rules read."""
    rx = section_rules().split(", bl AS (", 1)[1]
    cols = ", ".join(P)
    text_rules = ("step_therapy_requirements", "reauth_requirements")
    final = ", ".join(f"coalesce(r.{p}, f.{p}) AS {p}" if p not in text_rules else f"CASE WHEN f.{p} IS NULL OR f.{p} IN ('', 'NA', 'N/A') THEN coalesce(r.{p}, f.{p}) ELSE f.{p} END AS {p}" for p in P)
    defaults = ", ".join(f"CASE WHEN upper(brand) = 'STELARA' THEN '>=6' ELSE {lit(packs.DEFAULTS[p])} END AS {p}" if p == "age" else f"{lit(packs.DEFAULTS[p])} AS {p}" for p in P)
    stages = [
        ("rules", f"SELECT filename, brand, {cols} FROM rx WHERE {' AND '.join(f'{p} IS NOT NULL' for p in P)}"),
        ("chunked", f"SELECT filename, brand, {cols} FROM ma SEMI JOIN (SELECT filename, brand FROM ck WHERE chunked) USING (filename, brand)"),
        ("small", f"SELECT filename, brand, {cols} FROM sm SEMI JOIN (SELECT filename, brand FROM ck WHERE NOT chunked) USING (filename, brand)"),
        ("large", f"SELECT filename, brand, {model_says('text', True, None)} FROM ck WHERE NOT chunked AND {LARGE_READS}"),
        ("simplified", f"SELECT filename, brand, {model_says('text', True, None)} FROM (SELECT filename, brand, substring(text, 1, 800) AS text FROM cx) WHERE {LARGE_READS}"),
        ("defaults", f"SELECT filename, brand, {defaults} FROM cx"),
    ]
    every = " UNION ALL ".join(f"SELECT filename, brand, {cols}, {i} AS turn, '{n}' AS stage FROM ({q})" for i, (n, q) in enumerate(stages))
    return f"""WITH RECURSIVE {chunks()}, {chunk_answers()}, rx AS (SELECT * FROM (WITH bl AS ({rx}) SEMI JOIN cx USING (filename, brand)), st AS ({every}),
  f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY filename, brand ORDER BY turn) = 1) SELECT f.filename, f.brand, {final}, stage FROM f LEFT JOIN rx r USING (filename, brand)"""


def sanity() -> str:
    none = "step_therapy_requirements IN ('No', 'NA', 'N/A', '')"
    checks = {
        "not_a_bucket": "access_score NOT IN (0, 25, 50, 75, 100)",
        "high_with_steps": "access_score >= 75 AND b + g >= 2",
        "high_with_brands": "access_score > 50 AND b >= 2",
        "zero_without_steps": f"access_score = 0 AND {none} AND (step_through_phototherapy = 'Yes')::INT + (tb_test_required IN ('Yes', 'Y'))::INT + (quantity_limits = 'Yes')::INT + (specialist_types NOT IN ('NA', 'N/A', 'No', ''))::INT + (reauth_required = 'Yes')::INT < 3",
        "low_without_limits": f"access_score <= 25 AND b + g = 0 AND {none} AND reauth_required <> 'Yes' AND step_through_phototherapy <> 'Yes'",
        "steps_not_counted": "step_therapy_requirements = 'Yes' AND b + g = 0",
        "steps_denied": "step_therapy_requirements IN ('No', 'NA', 'N/A') AND b + g > 0",
        "reauth_empty": "reauth_required = 'Yes' AND reauth_duration IN ('NA', 'N/A', '') AND reauth_requirements IN ('NA', 'N/A', '')",
    }
    base = SCORED.replace("b, g, (CASE WHEN n_real", "b, g0 AS g, (CASE WHEN n_real")
    return base + " UNION ALL ".join(f"SELECT filename, brand, access_score, '{n}' AS finding FROM scored WHERE {c}" for n, c in checks.items())


def worded() -> str:
    """Pages wp and tasks wt in the pack's vocabulary, dt: their documents' types, tp: tasks by pages."""
    part = {n: f"([{', '.join(lit(v) for v in vs)}])[1 + (o_orderkey // {p}) % {len(vs)}]" for n, (p, vs) in PAGE_WORDING.items()}
    blank = "chr(10) || chr(10)"
    text = f"{part['head']} || {blank} || {part['rule']} || ' ' || {part['brand']} || {blank} || {part['step']} || ' ' || {part['renew']}"
    pairs = ", ".join(f"({lit(b)}, {lit(g)})" for b, g in packs.BRAND_GENERIC.items())
    words = ", ".join(f"({lit(w)})" for w in packs.PAGE_KEYWORDS["other_brands"][0])
    return f"""WITH wp AS (SELECT 'f' || (o_custkey % 400) AS filename, row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey) - 1 AS page_num, {text} AS text FROM orders),
  wt AS (SELECT DISTINCT 'f' || (o_custkey % 400) AS filename, unnest(['STELARA', CASE WHEN o_custkey % 2 = 0 THEN 'TREMFYA' ELSE 'COSENTYX' END]) AS brand FROM orders),
  pairs(b, g) AS (VALUES {pairs}), names(w) AS (VALUES {words}),
  own AS (SELECT w, coalesce(min(lower(b)), w) AS c FROM names LEFT JOIN pairs ON w = lower(b) OR w = g GROUP BY w),
  nb AS (SELECT filename, count(DISTINCT c) AS n_brands FROM wp JOIN own ON contains(lower(text), w) GROUP BY 1),
  pc AS (SELECT filename, count(*) AS n_pages, sum((page_num < 10 AND contains(lower(text), 'products affected') AND contains(lower(text), 'pa criteria'))::INT)::BIGINT AS catalog,
    sum((page_num < 30 AND regexp_matches(lower(text), 'go\\s+to\\s+#?\\s*[0-9]+'))::INT)::BIGINT AS jumps FROM wp GROUP BY 1),
  dt AS (SELECT filename, n_pages, coalesce(n_brands, 0)::INT AS n_brands, catalog, jumps, CASE WHEN coalesce(n_brands, 0) <= 1 OR n_pages <= 10 THEN 'single-drug' WHEN catalog >= 3 AND n_pages > 50 THEN 'flat-catalog' WHEN jumps >= 5 THEN 'decision-tree' ELSE 'multi-drug' END AS document_type FROM pc LEFT JOIN nb USING (filename)),
  tp AS (SELECT wt.filename, brand, page_num, text, lower(text) AS low, lower(brand) AS b, g FROM wt JOIN wp USING (filename) JOIN pairs ON pairs.b = brand)"""


def signal(c: str) -> str:
    return f"({has(c, packs.SIGNAL_WORDS)} OR regexp_matches({c}, {lit(packs.SIGNAL_PATTERN)}))"


def on_topic(c: str) -> str:
    return f"(NOT {has(c, packs.OTHER_INDICATIONS)} OR {signal(c)})"


def study(c: str) -> str:
    n, m = (" + ".join(f"len(regexp_extract_all(lower({c}), {lit(p)}))" for p in ps) for ps in (packs.STUDY_PATTERNS, packs.POLICY_PATTERNS))
    return f"(NOT (contains(lower({c}), b) OR contains(lower({c}), g)) AND ((({n}) > 10 AND ({m}) <= 2) OR (({n}) > 5 AND ({m}) = 0) OR (({n}) >= 8 AND ({n}) / greatest({m}, 1)::DOUBLE > 5)))"


def boundary() -> str:
    begins = " OR ".join(f"regexp_matches(substring(lower(trim(text)), 1, 500), {lit('(?m)' + p)})" for p in packs.SECTION_PATTERNS)
    return f"bd AS (SELECT filename, (CASE WHEN pos IS NULL THEN least(3, n) ELSE greatest(1, pos) END)::INT AS boundary FROM (SELECT filename, count(*) AS n, min(CASE WHEN page_num < 10 AND length(trim(text)) >= 100 AND ({begins}) THEN page_num END) AS pos FROM wp GROUP BY 1))"


def paras() -> str:
    words = [w for ws in packs.PARAM_KEYWORDS.values() for w in ws]
    return f"""pa AS (SELECT *, lower(para) AS pl FROM (SELECT filename, brand, page_num, b, g, (unnest(range(len(s))))::INT AS ord, unnest(s) AS para FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS s FROM tp WHERE NOT {study('text')})) WHERE length(para) >= 30),
  pk AS (SELECT *, ({signal('pl')})::INT + (contains(pl, b) OR contains(pl, g))::INT + ({has('pl', words)})::INT >= 2 AND {on_topic('pl')} AND NOT (length(para) > 300 AND {study('para')}) AS good FROM pa)"""


def snippets() -> str:
    hits = " UNION ALL ".join(f"SELECT *, {k} AS o, '{p}' AS param FROM se WHERE {has('lower(s)', ws)}" for k, (p, ws) in enumerate(packs.PARAM_KEYWORDS.items()))
    return f"""kp AS (SELECT filename, brand, page_num, [x FOR x IN list_transform(string_split(regexp_replace(text, '([.;])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)) IF length(x) >= 20] AS a
    FROM tp JOIN dt USING (filename) ANTI JOIN (SELECT * FROM pk WHERE good) k USING (filename, brand, page_num) WHERE document_type <> 'single-drug' AND n_pages > 10 AND (contains(low, b) OR contains(low, g) OR {signal('low')}) AND NOT {study('text')}),
  se AS (SELECT filename, brand, page_num, j::INT - 1 AS sent, a[j] AS s, array_to_string(a[greatest(1, j - 1):j + 1], ' ') AS snippet FROM (SELECT *, unnest(range(1, len(a) + 1)) AS j FROM kp) WHERE {on_topic('lower(a[j])')}),
  hi AS ({hits}), h1 AS (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY filename, brand, substring(snippet, 1, 100) ORDER BY page_num, o, sent) = 1)
  SELECT filename, brand, page_num, param, sent, snippet FROM h1 QUALIFY row_number() OVER (PARTITION BY filename, brand, param ORDER BY page_num, sent) <= 5"""


def tags() -> str:
    K = packs.PAGE_KEYWORDS
    score = f"CASE WHEN contains(low, b) OR contains(low, g) THEN 5::DOUBLE ELSE 0 END + " + " + ".join(f"CASE WHEN {has('low', ws)} THEN {w}::DOUBLE ELSE 0 END" for n, (ws, w) in K.items() if n != "other_brands")
    others = " OR ".join(f"(contains(low, {lit(w)}) AND {lit(w)} <> b AND {lit(w)} <> g)" for w in K["other_brands"][0])
    return f"""sc AS (SELECT tp.*, n_pages, document_type, {score} + CASE WHEN {others} THEN {K['other_brands'][1]}::DOUBLE ELSE 0 END AS r, {has('low', K['universal'][0])} AS uni, n_pages <= 50 OR {has('low', K['disease'][0])} OR contains(low, b) OR contains(low, g) AS firm FROM tp JOIN dt USING (filename)),
  h AS (SELECT *, r >= 3 AS hit, r >= 3 AND firm AS kept FROM sc),
  nn AS (SELECT *, coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS was, coalesce(lag(kept) OVER w, false) OR coalesce(lead(kept) OVER w, false) AS still FROM h WINDOW w AS (PARTITION BY filename, brand ORDER BY page_num)),
  tg AS (SELECT *, CASE WHEN kept THEN 'relevant' WHEN hit THEN 'irrelevant' WHEN uni THEN 'universal' WHEN was AND still THEN 'context' WHEN was THEN 'irrelevant' WHEN document_type = 'multi-drug' AND page_num < 5 THEN 'preamble' ELSE 'irrelevant' END AS tag, CASE WHEN hit AND NOT kept THEN 0.0 ELSE r END AS score FROM nn),
  ti AS (SELECT *, CASE WHEN document_type = 'single-drug' OR n_pages <= 15 THEN true WHEN count(*) FILTER (WHERE tag = 'relevant') OVER (PARTITION BY filename, brand) < 2 THEN score > 0 OR tag IN ('preamble', 'universal') ELSE tag <> 'irrelevant' END AS included FROM tg)"""


def preferred() -> str:
    first = lambda n: f"strpos(low, regexp_extract(low, 'preferred.{{0,200}}' || {n}))"
    away = " OR ".join(f"regexp_matches(low, 'non-preferred.{{0,200}}' || {n}) OR regexp_matches(low, {n} || '.{{0,200}}non-preferred')" for n in ("b", "g"))
    good = " OR ".join(f"(regexp_matches(low, 'preferred.{{0,200}}' || {n}) AND NOT contains(substring(low, greatest(1, {first(n)} - 15), least({first(n)} - 1, 15)), 'non-preferred'))" for n in ("b", "g"))
    return f"st AS (SELECT *, CASE WHEN page_num >= 15 THEN NULL WHEN (contains(low, 'non-preferred') OR contains(low, 'non preferred')) AND ({away}) THEN 'non-preferred' WHEN {good} THEN 'preferred' END AS status FROM tp) SELECT filename, brand, coalesce(arg_min(status, page_num) FILTER (WHERE status IS NOT NULL), 'unknown') AS preferred_status FROM st GROUP BY 1, 2"


def mention_counts() -> str:
    classes = {d: "branded" for d in packs.BIOLOGICS} | {d: "generic" for d in packs.BIOSIMILARS} | {d: "generic" for d in packs.GENERICS}
    for b, g in packs.BRAND_GENERIC.items():
        classes[g] = "generic" if b.lower() in packs.BIOSIMILARS else "branded"
    rows = ", ".join(f"({lit(d)}, {lit(k)})" for d, k in classes.items() if len(d) >= 4)
    return worded() + f""", dr(name, classification) AS (VALUES {rows}), pp AS (SELECT name, classification, text, string_split(regexp_replace(lower(text), '\\b' || name || '\\b', chr(1), 'g'), chr(1)) AS s FROM wp JOIN dr ON contains(lower(text), name)),
  ps AS (SELECT name, classification, text, list_sum(list_transform(s[1:j], lambda x: length(x))) + (j - 1) * length(name) AS pos FROM (SELECT *, unnest(range(1, len(s))) AS j FROM pp))
  SELECT name, classification, count(*) AS n, sum(length(trim(replace(substring(text, greatest(0, pos - 100)::INT + 1, (least(pos, 100) + length(name) + 100)::INT), chr(10), ' '))))::BIGINT AS chars FROM ps GROUP BY 1, 2"""


def layout_rules() -> str:
    """What the rules find in the derived layout, from the fields that it was made of."""
    who = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(specialist_types), '{s}') THEN '{s.capitalize()}' END" for s in ("dermatologist", "rheumatologist", "gastroenterologist", "immunologist")) + "], lambda x: x IS NOT NULL), ', ')"
    ages = " ".join(f"WHEN regexp_matches(lower(age), {lit(p)}) THEN '>=' || regexp_extract(lower(age), {lit(p)}, 1)" for p in (r"([0-9]{1,2})\s*years?\s*of\s*age\s*or\s*older", r"at\s*least\s*([0-9]{1,2})\s*years?\s*of\s*age", r"([0-9]{1,2})\s*years?\s*and\s*older", r"aged?\s*([0-9]{1,2})\s*or\s*older", r"must\s*be\s*(?:at\s*least\s*)?([0-9]{1,2})\s*years?"))
    return f"""WITH {raw()} SELECT filename, brand, CASE {ages} ELSE age END AS age, step_therapy_requirements || '. Trial of two preferred products or phototherapy. Methotrexate was ineffective.' AS step_therapy_requirements,
  NULL::VARCHAR AS steps_through_brands, '1' AS steps_through_generic, 'No' AS step_through_phototherapy, 'Y' AS tb_test_required, NULL::VARCHAR AS quantity_limits, nullif({who}, '') AS specialist_types,
  '6' AS initial_auth_duration, '12' AS reauth_duration, 'Yes' AS reauth_required, reauth_requirements || ' reauthorization needs a negative tuberculin test.' AS reauth_requirements FROM raw"""


def sections() -> str:
    """Pages gp and tasks gt of derived sections, sec: each task's section text."""
    part = {n: f"([{', '.join(lit(v) for v in vs)}])[1 + (o_orderkey // {p}) % {len(vs)}]" for n, (p, vs) in SECTION_WORDING.items()}
    nl = "chr(10)"
    text = f"replace({part['head']}, '{{}}', {part['drug']}) || {nl} || ' Required Medical Information ' || {part['info']} || '. ' || {part['other']} || {nl} || 'Age Restrictions ' || {part['age']} || {nl} || 'Prescriber Restrictions ' || {part['who']} || {nl} || 'Coverage Duration ' || {part['cover']} || {nl} || 'Renewal Criteria ' || {part['renew']} || {nl} || 'Effective Date 01/01' || {nl} || {part['tail']}"
    names = ", ".join(f"({lit(b)}, {lit(n.lower())})" for b in SECTION_BRANDS for n in {b, *packs.DRUG_ALIASES.get(b.upper(), [])})
    top = "lower(trim(regexp_replace(substring(text, 1, 900), '\\s+', ' ', 'g')))"
    return f"""gp AS (SELECT 's' || (o_custkey % 300) AS filename, row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderkey) - 1 AS page_num, {text} AS text FROM orders),
  gn(brand, name) AS (VALUES {names}), gt AS (SELECT DISTINCT 's' || (o_custkey % 300) AS filename, unnest([{', '.join(lit(b) for b in SECTION_BRANDS)}]) AS brand FROM orders),
  gm AS (SELECT t.filename, t.brand, page_num, text, bool_or(contains(lower(text), name)) AS named, {has('lower(substring(text, 1, 1200))', packs.START_MARKS)} AS starts,
    contains({top}, 'products affected') AND (contains({top}, 'prior authorization criteria') OR contains({top}, 'criteria details')) AS opens FROM gt t JOIN gp USING (filename) JOIN gn USING (brand) GROUP BY ALL),
  gb AS (SELECT filename, brand, min(page_num) AS first FROM gm WHERE named AND starts GROUP BY 1, 2),
  ge AS (SELECT filename, brand, first, min(page_num) FILTER (WHERE opens AND NOT named AND page_num > first) AS last FROM gm JOIN gb USING (filename, brand) GROUP BY 1, 2, 3),
  sec AS (SELECT filename, brand, {spaces("string_agg(text, chr(10) ORDER BY page_num)")} AS text FROM gm JOIN ge USING (filename, brand) WHERE page_num >= first AND (last IS NULL OR page_num < last) GROUP BY 1, 2)"""


def spaces(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), '\n\\s+', chr(10), 'g'), '\\s+\n', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


def compacted(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def section_rules() -> str:
    """What stands in each block of a section, and what the wording of the rules makes of it."""
    def block(start, ends):
        got = f"regexp_extract(text, '(?is){start}\\s*(.*?)(?:{'|'.join(ends)}|\\z)', 1)"
        value = spaces(f"regexp_replace({spaces(got)}, '(?i)^(Information|Restrictions|Duration|Criteria)\\s+', '')")
        return f"CASE WHEN regexp_matches(text, '(?is){start}') AND {value} NOT IN ('', '-', '—') THEN {value} END"

    L = extract.LABELS
    low_age = f"lower({compacted('age')})"
    ages = " ".join(f"WHEN regexp_matches({low_age}, {lit(p)}) THEN '>=' || regexp_extract({low_age}, {lit(p)}, 1)" for p in extract.AGE_RULES)
    who = "nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(who), {lit(k)}) THEN {lit(v)} END" for k, v in extract.SPECIALISTS.items()) + "], lambda x: x IS NOT NULL), ', '), '')"
    months = lambda label, unit: f"try_cast(nullif(regexp_extract(coalesce(cover, text), '(?i)\\b{label}\\s*:\\s*([0-9]+)\\s*{unit}s?', 1), '') AS INT)"
    weeks = lambda label: f"round_even({months(label, 'week')} / 4.0, 0)::INT"
    return f"""WITH {sections()}, bl AS (SELECT filename, brand, text, {block('Required\\s+Medical\\s+Information', L)} AS info, {block(L[0], L[1:])} AS age, {block(L[1], L[2:])} AS who, {block(L[2], L[3:])} AS cover, {block(L[3], L[4:])} AS again FROM sec
    WHERE {' + '.join(f"contains(lower(substring(text, 1, 500)), {lit(m)})::INT" for m in packs.LAYOUT_MARKS)} >= 2), k AS (SELECT *, lower(info) AS i, coalesce({months('renewal', 'month')}, {months('reauthorization', 'month')}, {weeks('renewal')}) AS renewal FROM bl)
  SELECT filename, brand, CASE WHEN age IS NULL THEN NULL {ages} WHEN {has(low_age, ['childbearing', 'able to bear children', 'pregnancy'])} THEN NULL ELSE {compacted('age')} END AS age,
    nullif({compacted(f"replace({compacted('info')}, '• ', '')")}, '') AS step_therapy_requirements,
    CASE WHEN regexp_matches(i, {lit(extract.TWO_BRANDS)}) THEN '2' WHEN regexp_matches(i, {lit(extract.ONE_BRAND)}) THEN '1' WHEN contains(i, 'biologic as first-line') THEN '0' END AS steps_through_brands,
    CASE WHEN regexp_matches(i, 'at\\s+least\\s+(?:2|two)\\s+conventional\\s+therap') OR regexp_matches(i, '\\b(?:2|two)\\s+(?:topical|generic|non-biologic|conventional)') THEN '2' WHEN {has('i', extract.GENERIC_TERMS)} THEN '1' END AS steps_through_generic,
    CASE WHEN {has('i', ['phototherapy', 'puva', 'uvb'])} THEN CASE WHEN {has('i', ['one of the following', 'conventional therapies', 'or '])} THEN 'No' ELSE 'Yes' END END AS step_through_phototherapy,
    CASE WHEN regexp_matches(lower(text), '\\bnegative\\s+tuberculin\\b|\\btb\\s+test\\b|\\btuberculosis\\b|\\blatent\\s+tb\\b') THEN 'Y' END AS tb_test_required, CASE WHEN contains(lower(text), 'quantity limit') THEN 'Yes' END AS quantity_limits,
    {who} AS specialist_types, coalesce({months('initial', 'month')}, {weeks('initial')})::VARCHAR AS initial_auth_duration, renewal::VARCHAR AS reauth_duration, CASE WHEN renewal IS NOT NULL OR again IS NOT NULL THEN 'Yes' END AS reauth_required,
    nullif(trim(regexp_replace({compacted('again')}, '(?i)^Renewal Criteria:\\s*', '')), '') AS reauth_requirements FROM k"""


def drug_rows() -> str:
    """dr: every drug name of at least four letters, its class and its place in the dictionary."""
    classes = {d: "branded" for d in packs.BIOLOGICS} | {d: "generic" for d in packs.BIOSIMILARS} | {d: "generic" for d in packs.GENERICS}
    for b, g in packs.BRAND_GENERIC.items():
        classes[g] = "generic" if b.lower() in packs.BIOSIMILARS else "branded"
    return "dr(name, classification, ord) AS (VALUES " + ", ".join(f"({lit(d)}, {lit(k)}, {i})" for i, (d, k) in enumerate((d, k) for d, k in classes.items() if len(d) >= 4)) + ")"


def linked(c: str) -> str:
    low = f"lower({c})"
    n = lambda w: f"len(regexp_extract_all({low}, '\\b{w}\\b'))"
    return f"CASE WHEN {has(low, packs.AND_MARKERS)} THEN 'AND' WHEN {has(low, packs.OR_MARKERS)} THEN 'OR' WHEN {n('or')} > {n('and')} THEN 'OR' WHEN {n('and')} > 0 THEN 'AND' ELSE 'OR' END"


def step_rows(src: str) -> str:
    """rq: the first match of each step pattern in ``src``'s texts, with the names in its source."""
    counts = {w: str(n) for n, ws in enumerate((("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5")), 1) for w in ws}
    word = lambda g: f"CASE lower({g}) {' '.join(f'WHEN {lit(w)} THEN {n}' for w, n in counts.items())} ELSE 1 END"
    one = []
    for k, (p, kind, group) in enumerate(extract.STEP_PATTERNS):
        n = word(f"regexp_extract(text, {lit(p)}, {group})") if group else ("2" if kind == "branded_all" else "1")
        one.append(f"SELECT filename, brand, text, {k} AS no, {n} AS count, '{kind.split('_')[0]}' AS drug_type, regexp_extract(text, {lit(p)}) AS m FROM {src} WHERE regexp_matches(text, {lit(p)})")
    return f"""{drug_rows()}, r0 AS (SELECT *, strpos(text, m) - 1 AS a, strpos(text, m) - 1 + length(m) AS z FROM ({' UNION ALL '.join(one)})),
  r1 AS (SELECT filename, brand, no, count, drug_type, greatest(0, a - 50) AS s, least(length(text), z + 100) AS e, substring(text, greatest(0, a - 50)::INT + 1, (least(length(text), z + 100) - greatest(0, a - 50))::INT) AS source_text, substring(text, greatest(0, a - 300)::INT + 1, (z + 300 - greatest(0, a - 300))::INT) AS wide FROM r0),
  r2 AS (SELECT filename, brand, no, string_agg(repeat(name || ',', len(regexp_extract_all(lower(source_text), '\\b' || name || '\\b'))::INT), '' ORDER BY ord) AS drugs FROM r1 JOIN dr ON contains(lower(source_text), name) GROUP BY 1, 2, 3),
  rq AS (SELECT filename, brand, (row_number() OVER (PARTITION BY filename, brand ORDER BY no) - 1)::INT AS no, count, drug_type, {linked('wide')} AS connector, source_text, coalesce(rtrim(drugs, ','), '') AS drugs FROM r1 LEFT JOIN r2 USING (filename, brand, no))"""


def steps_found(src: str) -> str:
    """P7, P5 and P6 over ``src``'s texts."""
    photo, named = has("lower(x)", extract.PHOTO), "(?:phototherapy|puva|uvb)"
    pieces = "string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))"
    return step_rows(src) + f""", ct AS (SELECT filename, brand, count(*) AS n, coalesce(sum(count) FILTER (WHERE drug_type = 'generic' AND connector = 'AND'), 0) AS ga, coalesce(sum(count) FILTER (WHERE drug_type = 'branded' AND connector = 'AND'), 0) AS ba,
      min(count) FILTER (WHERE drug_type = 'generic' AND connector = 'OR') AS go, min(count) FILTER (WHERE drug_type = 'branded' AND connector = 'OR') AS bo FROM rq GROUP BY 1, 2),
    dm AS (SELECT filename, brand, sum(len(regexp_extract_all(lower(text), '\\b' || name || '\\b')))::INT AS n_mentions FROM {src} JOIN dr ON contains(lower(text), name) GROUP BY 1, 2),
    ps AS (SELECT filename, brand, (unnest(range(len(p))))::INT AS j, unnest(p) AS x FROM (SELECT filename, brand, {pieces} AS p FROM {src})),
    ph AS (SELECT filename, brand, j, lower(x) AS l, bool_or(regexp_matches(lower(x), '{named}.*?\\bor\\b|\\bor\\b.*?{named}') OR {has('lower(x)', ['one of the following', 'any of the following', 'either'])}) OVER (PARTITION BY filename, brand ORDER BY j) AS either FROM ps WHERE {photo}),
    pq AS (SELECT filename, brand, bool_or(either) AS in_or, bool_or(NOT either AND regexp_matches(l, '{named}\\s+(?:has been|was)\\s+(?:ineffective|inadequate|unsuccessful)|(?:trial|failure)\\s+(?:of|and)\\s+{named}')) AS alone FROM ph GROUP BY 1, 2),
    re AS (SELECT filename, brand, string_agg(trim(x), chr(10) ORDER BY j) AS reauth_text FROM (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY filename, brand ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ps WHERE {has('lower(x)', packs.REAUTH_SENTENCE_WORDS)}) WHERE before <= 1500 GROUP BY 1, 2)
  SELECT filename, brand, CASE WHEN coalesce(ba, 0) + CASE WHEN go IS NULL THEN coalesce(bo, 0) ELSE 0 END > 0 THEN (coalesce(ba, 0) + CASE WHEN go IS NULL THEN coalesce(bo, 0) ELSE 0 END)::VARCHAR ELSE 'NA' END AS branded_steps,
    CASE WHEN coalesce(ga, 0) + coalesce(go, 0) > 0 THEN (coalesce(ga, 0) + coalesce(go, 0))::VARCHAR ELSE 'NA' END AS generic_steps, CASE WHEN coalesce(n, 0) >= 2 THEN 'high' WHEN n = 1 OR coalesce(n_mentions, 0) > 0 THEN 'medium' ELSE 'low' END AS confidence,
    alone AND NOT in_or AS phototherapy_mandatory, coalesce(in_or, false) AS phototherapy_in_or, coalesce(n, 0)::INT AS n_requirements, coalesce(n_mentions, 0) AS n_mentions, coalesce(reauth_text, '') AS reauth_text
  FROM {src} LEFT JOIN ct USING (filename, brand) LEFT JOIN dm USING (filename, brand) LEFT JOIN pq USING (filename, brand) LEFT JOIN re USING (filename, brand)"""


def packages(level: str, clean: str) -> str:
    """Contexts of tasks put together from the rows of their level; ``clean`` cleans ``text``."""
    nl, rule = "chr(10)", "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    two = f"{nl} || {nl}"
    bare = "trim({}, ' ' || chr(9) || chr(10) || chr(13))".format
    late = " OR ".join(f"regexp_matches(lower(text), {lit(p)})" for p in [*packs.UNIVERSAL_PATTERNS, *packs.TIER_PATTERNS])
    shared = f"""{boundary()}, up AS (SELECT filename, page_num, {bare('text')} AS t FROM wp JOIN bd USING (filename) JOIN dt USING (filename) WHERE document_type = 'multi-drug' AND ((page_num < boundary AND {bare('text')} <> '') OR (page_num >= boundary AND ({late})))),
  ut AS (SELECT filename, string_agg('[Universal | Page ' || (page_num + 1) || ']' || {nl} || t, {two} ORDER BY page_num) AS universal_text FROM up GROUP BY 1), ps AS (WITH {preferred()})"""
    if level == "page":
        renew, disease = has("low", packs.REAUTH_WORDS), has("low", packs.PAGE_KEYWORDS["disease"][0])
        own = lambda name, where, order: f"{name} AS (SELECT filename, brand, string_agg('[Page ' || (page_num + 1) || ']' || {nl} || {bare('text')}, {two} ORDER BY {order}) AS v FROM ti WHERE {where} GROUP BY 1, 2)"
        body = f"""{tags()}, {own('se', "included AND tag IN ('relevant', 'context')", 'page_num')}, {own('re', f'{renew} AND (included OR {disease})', '(NOT included)::INT, page_num')}, {own('li', f"included AND {has('low', packs.LIMIT_PHRASES)}", 'page_num')},
  fu AS (SELECT filename, brand, string_agg('[Page ' || (page_num + 1) || ' | Tag: ' || tag || ']' || {nl} || {bare('text')}, {rule} ORDER BY page_num) AS v, count(*) AS used FROM ti WHERE included GROUP BY 1, 2),
  pk_ AS (SELECT wt.filename, wt.brand, coalesce(universal_text, '') AS universal_text, coalesce(se.v, '') AS section_text, coalesce(re.v, '') AS reauthorization_text, coalesce(li.v, '') AS quantity_limit_text, coalesce(fu.v, '') AS text, coalesce(used, 0) AS pages_used FROM wt LEFT JOIN ut USING (filename) LEFT JOIN se USING (filename, brand) LEFT JOIN re USING (filename, brand) LEFT JOIN li USING (filename, brand) LEFT JOIN fu USING (filename, brand))"""
    elif level == "paragraph":
        body = f"""{paras()}, se AS (SELECT filename, brand, string_agg('[Page ' || (page_num + 1) || ']' || {nl} || para, {two} ORDER BY page_num, ord) AS v, count(DISTINCT page_num) AS used FROM pk WHERE good GROUP BY 1, 2),
  pk_ AS (SELECT filename, brand, coalesce(universal_text, '') AS universal_text, coalesce(v, '') AS section_text, '' AS reauthorization_text, '' AS quantity_limit_text, array_to_string([x FOR x IN [coalesce(universal_text, ''), coalesce(v, '')] IF x <> ''], {rule}) AS text, coalesce(used, 0) AS pages_used FROM wt LEFT JOIN ut USING (filename) LEFT JOIN se USING (filename, brand))"""
    else:
        order = "CASE param " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(packs.PARAM_KEYWORDS)) + " END"
        body = f"""{paras()}, q AS (SELECT pk.*, {signal('pl')} AS sig, bool_or(good) OVER (PARTITION BY pk.filename, pk.brand) AS found FROM pk JOIN dt USING (filename) WHERE document_type <> 'single-drug'),
  sr AS (SELECT filename, brand, page_num, ord, para FROM q WHERE CASE WHEN found THEN good ELSE sig END UNION ALL SELECT filename, brand, page_num, 0, {bare('text')} FROM tp JOIN dt USING (filename) WHERE document_type = 'single-drug' AND {bare('text')} <> ''),
  sn AS (WITH kp0 AS (SELECT 1), {snippets().replace('ANTI JOIN (SELECT * FROM pk WHERE good) k', 'ANTI JOIN sr k')}),
  se AS (SELECT filename, brand, string_agg('[PsO Section | Page ' || (page_num + 1) || ']' || {nl} || para, {two} ORDER BY page_num, ord) AS v FROM sr GROUP BY 1, 2),
  l1 AS (SELECT filename, brand, param, string_agg('  - ' || snippet, {nl} ORDER BY page_num, sent) AS lines FROM sn GROUP BY 1, 2, 3),
  l2 AS (SELECT filename, brand, '[PARAMETER-SPECIFIC SNIPPETS]' || {nl} || string_agg('[' || upper(replace(param, '_', ' ')) || ']' || {nl} || lines, {two} ORDER BY {order}) AS shown FROM l1 GROUP BY 1, 2),
  us AS (SELECT filename, brand, count(*) AS used FROM (SELECT filename, brand, page_num FROM sr UNION SELECT filename, brand, page_num FROM wt JOIN up USING (filename) JOIN dt USING (filename) WHERE document_type <> 'single-drug' AND n_pages > 10) GROUP BY 1, 2),
  pk_ AS (SELECT wt.filename, wt.brand, coalesce(universal_text, '') AS universal_text, coalesce(v, '') AS section_text, '' AS reauthorization_text, '' AS quantity_limit_text, array_to_string([x FOR x IN [coalesce(universal_text, ''), coalesce(v, ''), coalesce(shown, '')] IF x <> ''], {rule}) AS text,
    CASE WHEN used IS NULL AND (document_type = 'single-drug' OR n_pages <= 10) THEN n_pages ELSE coalesce(used, 0) END AS pages_used FROM wt JOIN dt USING (filename) LEFT JOIN ut USING (filename) LEFT JOIN se USING (filename, brand) LEFT JOIN l2 USING (filename, brand) LEFT JOIN us USING (filename, brand))"""
    return worded() + f""", {shared}, {body} SELECT pk_.filename, pk_.brand, document_type, preferred_status, n_pages AS total_pages, pages_used, universal_text, section_text, reauthorization_text, quantity_limit_text, {clean} AS full_text FROM pk_ JOIN dt USING (filename) JOIN ps USING (filename, brand)"""


def study_texts() -> str:
    return "sx AS (SELECT 'd' || o_orderkey AS filename, CASE WHEN o_orderkey % 5 = 0 THEN 'STELARA' ELSE 'OTEZLA' END AS brand, CASE WHEN o_orderkey % 5 = 0 THEN 'stelara' ELSE 'otezla' END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'ustekinumab' ELSE 'apremilast' END AS g, repeat('A randomized study. ', (o_orderkey % 9)::INT) || repeat('The criteria hold. ', (o_orderkey % 4)::INT) || CASE WHEN o_orderkey % 7 = 0 THEN 'Apremilast, et al (2019)' ELSE 'A cohort.' END AS text FROM orders)"


def brand_sections(name: str = "license", size: int = 2400, small: int = 1000) -> str:
    """The part of each document that is about a name, by the first way that finds one."""
    places = lambda w: f"list_transform(range(1, len(string_split(low, {lit(w)}))), lambda j: list_sum(list_transform(string_split(low, {lit(w)})[1:j], lambda x: length(x))) + (j - 1) * {len(w)})"
    said = ", ".join(f"nullif(strpos(low, {lit(p.format(name))}), 0) - 1" for p in packs.APPROVAL_PHRASES)
    near = f"lambda x: contains(substring(low, (greatest(x - 3000, 0) + 1)::INT, least(x, 3000)::INT), {lit(name)}) OR contains(substring(low, (x + 1)::INT, 3000), {lit(name)})"
    marks = ", ".join(f"list_filter({places(m)}, {near})[1]" for m in packs.CRITERIA_MARKS)
    around = f"substring(low, (greatest(x - 1000, 0) + 1)::INT, (x - greatest(x - 1000, 0) + {len(name)} + 1000)::INT)"
    named = f"list_filter({places(name)}, lambda x: {has(around, packs.NEAR_WORDS)})[1]"
    return f"""WITH a AS (SELECT doc_id, text, lower(text) AS low FROM documents), b AS (SELECT doc_id, text, coalesce(greatest(coalesce({said}) - 500, 0), greatest(coalesce({marks}) - 500, 0), greatest({named} - 1000, 0), nullif(strpos(low, '[pso section'), 0) - 1, 0) AS start FROM a WHERE length(text) > {small})
  SELECT doc_id, substring(text, (start + 1)::INT, {size}) AS section FROM b UNION ALL SELECT doc_id, text FROM documents WHERE length(text) <= {small}"""


def found_of_all() -> str:
    """What every check finds, in one shape."""
    base = base_sql()
    quoted = lambda **d: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || coalesce('\"' || ({v})::VARCHAR || '\"', 'null')" for k, v in sorted(d.items())) + " || '}'"
    parts = [
        ("inconsistent", "filename", "NULL", '"column"', quoted(n_values="n_values", spread="spread"), "\"column\" || ' differs between the brands of the file'", base["cross_row_consistency"]),
        ("drift", "NULL", "brand", '"column"', quoted(value="value", pct="pct", actual_pct="actual_pct"), "\"column\" || ' = ' || value || ' is as common as it shouldn''t be'", base["distribution_drift"]),
        ("incomplete", "filename", "brand", '"column"', quoted(gap="kind"), "\"column\" || ' is ' || kind", base["completeness"]),
        ("pair", "filename", "brand", "NULL", quoted(pair="kind"), "'pair is ' || kind", base["expected_vs_actual"]),
        ("score", "filename", "upper(brand)", "'access_score'", quoted(finding="finding", access_score="access_score"), "finding", base["score_sanity"]),
        ("rule", "filename", "brand", "NULL", quoted(rule="r"), "'corrected by ' || r", f"SELECT filename, brand, unnest(string_split(violations, ',')) AS r FROM ({base['business_rules']}) WHERE violations <> ''"),
    ]
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, {f}::VARCHAR AS filename, {b}::VARCHAR AS brand, {c}::VARCHAR AS \"column\", {d} AS detail, {m} AS message FROM ({q})" for k, f, b, c, d, m, q in parts)


def unfolded(src: str, key: str, l: str, no: str, value: str) -> str:
    """A row for each element of the list ``l``."""
    return f"SELECT {key}, (j - 1)::INT AS {no}, l[j] AS {value} FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT {key}, {l} AS l FROM {src}))"


SENTENCE_LIST = "string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))"


def within(f: str, budget: int) -> str:
    """Pieces of the list ``f`` until their length reaches the budget, stripped and joined; else the text's head."""
    return f"CASE WHEN len({f}) > 0 THEN array_to_string(list_transform(list_filter(range(1, len({f}) + 1), lambda i: coalesce(list_sum(list_transform({f}[1:i - 1], lambda y: length(y))), 0) < {budget}), lambda i: trim({f}[i])), chr(10)) ELSE substring(text, 1, {budget}) END"


def snippets_of() -> str:
    lists = {p: f"list_filter(s, lambda x: {has('lower(x)', packs.PARAM_KEYWORDS[packs.SNIPPET_KEYWORDS[p]])} OR contains(lower(x), lower(brand)))" for p in packs.SIMPLE_PARAMS}
    return f"WITH {sections()}, sl AS (SELECT *, {SENTENCE_LIST} AS s FROM sec), fl AS (SELECT filename, brand, text, {', '.join(f'{f} AS f_{p}' for p, f in lists.items())} FROM sl) SELECT filename, brand, {', '.join(f'{within(f'f_{p}', 400)} AS {p}' for p in lists)} FROM fl"


def focused_text() -> str:
    hits = " + ".join(f"contains(lower(c[k + 1]), '{w}')::INT" for w in ("license", "token", "mail"))
    return f"""WITH c AS (SELECT doc_id, text, list_transform(range(CASE WHEN length(text) <= 3000 THEN 1 ELSE ceil((length(text) - 250) / 2750.0)::INT END), lambda k: substring(text, (k * 2750 + 1)::INT, 3000)) AS c FROM documents),
  r AS (SELECT doc_id, k, -({hits}) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY -({hits}), k) AS turn FROM (SELECT *, unnest(range(len(c))) AS k FROM c) WHERE {hits} > 0),
  n AS (SELECT DISTINCT doc_id, k + unnest([-1, 0, 1]) AS k FROM r WHERE turn <= 8), m AS (SELECT doc_id, k FROM n UNION SELECT doc_id, unnest([0, 1, 2]) FROM c ANTI JOIN n USING (doc_id)),
  t AS (SELECT doc_id, string_agg(c[k + 1], chr(10) || chr(10) ORDER BY k) AS t FROM m JOIN c USING (doc_id) WHERE k BETWEEN 0 AND len(c) - 1 GROUP BY 1),
  f AS (SELECT doc_id, CASE WHEN length(text) <= 7000 THEN text ELSE substring(t, 1, 7000) END AS t FROM c JOIN t USING (doc_id)) SELECT doc_id, length(t)::INT AS chars, md5(t) AS text_md5 FROM f"""


def analysis_blocks() -> str:
    """The block of each page's step analysis, from its rows."""
    nl = "chr(10)"
    found = steps_found("wq").replace("SELECT filename, brand, CASE WHEN coalesce(ba", "SELECT filename, brand, CASE WHEN coalesce(ba", 1)
    head, tail = found.rsplit("\n  SELECT filename, brand, CASE WHEN coalesce(ba", 1)
    first_five = "string_split(drugs, ',')"
    line = f"(no + 1) || '. ' || count || ' ' || drug_type || ' [' || connector || ']: ' || CASE WHEN drugs = '' THEN '' ELSE array_to_string({first_five}[1:5], ', ') || CASE WHEN len({first_five}) > 5 THEN ' (+' || (len({first_five}) - 5) || ' more)' ELSE '' END END || {nl} || '   \"' || replace(substring(source_text, 1, 200), {nl}, ' ') || '\"'"
    counted = lambda kind: f"string_agg(count::VARCHAR, ', ' ORDER BY no) FILTER (WHERE drug_type = '{kind}' AND connector = 'OR')"
    return worded() + f""", wq AS (SELECT filename, page_num::VARCHAR AS brand, text FROM wp), {head}, fs AS (SELECT filename, brand, CASE WHEN coalesce(ba{tail}),
    ln AS (SELECT filename, brand, string_agg({line}, {nl} ORDER BY no) AS lines, string_agg(connector || ': ' || count || ' ' || drug_type || ' from ' || substring(source_text, 1, 80), ' | ' ORDER BY no) AS why,
      min(count) FILTER (WHERE drug_type = 'generic' AND connector = 'OR') AS g, min(count) FILTER (WHERE drug_type = 'branded' AND connector = 'OR') AS b, {counted('generic')} AS gs, {counted('branded')} AS bs FROM rq GROUP BY 1, 2),
    al AS (SELECT fs.*, lines, array_to_string([x FOR x IN [why, CASE WHEN g IS NOT NULL AND b IS NOT NULL THEN 'least of OR: brands [' || bs || '], generics [' || gs || ']: ' || g || ' generic' WHEN b IS NOT NULL THEN 'least of OR: ' || b || ' branded of [' || bs || ']' WHEN g IS NOT NULL THEN 'least of OR: ' || g || ' generic of [' || gs || ']' END,
      CASE WHEN n_requirements = 0 AND n_mentions > 0 THEN 'no pattern, drug mentions: ' || n_mentions WHEN n_requirements = 0 THEN 'no pattern, no drug mention' END] IF x IS NOT NULL], ' | ') AS why FROM fs LEFT JOIN ln USING (filename, brand)),
    bk AS (SELECT filename, brand, CASE WHEN n_requirements > 0 THEN 'STEP REQUIREMENTS: ' || n_requirements || {nl} || lines ELSE 'STEP REQUIREMENTS: none' END || {nl} || 'phototherapy: ' || CASE WHEN phototherapy_mandatory THEN 'mandatory' WHEN phototherapy_in_or THEN 'one of several options' WHEN phototherapy_mandatory IS NOT NULL THEN 'not required' ELSE 'not mentioned' END
      || {nl} || {nl} || 'steps_through_brands: ' || branded_steps || {nl} || 'steps_through_generic: ' || generic_steps || {nl} || 'step_through_phototherapy: ' || CASE WHEN phototherapy_mandatory THEN 'Yes' WHEN phototherapy_mandatory IS NOT NULL OR phototherapy_in_or THEN 'No' ELSE 'N/A' END || {nl} || 'confidence: ' || confidence || CASE WHEN why <> '' THEN {nl} || 'reasoning: ' || why ELSE '' END AS analysis FROM al)
  SELECT filename, brand, length(analysis)::INT AS chars, analysis FROM bk"""


def paragraph_list() -> str:
    """The three ways in which a text is cut into paragraphs."""
    blank = "trim({}, ' ' || chr(9) || chr(10) || chr(13))".format
    solid = lambda e: f"list_filter(list_transform({e}, lambda p: {blank('p')}), lambda p: p <> '')"
    marks = "text"
    for m in ("([0-9]+[.)]\\s)", "([a-zA-Z][.)]\\s)", "(•\\s)", "([-–]\\s)"):
        marks = f"regexp_replace({marks}, '\\n{m}', chr(1) || '\\1', 'g')"
    flat = "replace(p, chr(10), ' ')"
    sents = f"[y FOR y IN [trim(regexp_replace(x, '^\\s*[0-9]+[.)]\\s+', '')) FOR x IN string_split(regexp_replace({flat}, '([.;])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))] IF length(y) >= 20]"
    last = "string_split(acc, chr(1))[-1]"
    joined = f"acc || CASE WHEN {last} = '' THEN '' ELSE chr(2) END || x"
    grouped = f"list_reduce([''] || {sents}, lambda acc, x: CASE WHEN length(replace({last}, chr(2), '')) + length(x) >= 500 THEN {joined} || chr(1) ELSE {joined} END)"
    return f"""SELECT doc_id, CASE WHEN len(b) > 1 THEN {solid('b')} WHEN len(m) = 1 AND length(m[1]) > 1000 THEN list_filter(string_split(replace({grouped.replace(flat, "replace(m[1], chr(10), ' ')")}, chr(2), ' '), chr(1)), lambda p: p <> '') ELSE m END AS l
      FROM (SELECT doc_id, text, string_split(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), chr(1)) AS b, {solid(f"string_split({marks}, chr(1))")} AS m FROM documents)"""


def more_sql() -> dict[str, str]:
    """Context tiers, document types, small reports and text shaping."""
    W, n_real = worded(), " + ".join(f"(coalesce({p}, '') NOT IN ('NA', 'N/A', '', 'None', 'No'))::INT" for p in P)
    late = " OR ".join(f"regexp_matches(lower(text), {lit(p)})" for p in [*packs.UNIVERSAL_PATTERNS, *packs.TIER_PATTERNS])
    disease, renew = has("low", packs.PAGE_KEYWORDS["disease"][0]), has("low", packs.REAUTH_WORDS)
    na = lambda c: f"(lower(trim({c})) IN {among(packs.GAP_FORMS)})"
    conf = SCORED + ", k AS (SELECT s.filename, s.brand, CASE WHEN estimated_access_score IS NOT NULL THEN least(100, greatest(0, estimated_access_score)) END AS llm_estimate, access_score AS deterministic FROM scored s JOIN raw USING (filename, brand)), v AS (SELECT *, abs(llm_estimate - deterministic) AS diff, CASE WHEN llm_estimate IS NULL THEN 'N/A' WHEN abs(llm_estimate - deterministic) <= 15 THEN 'High' WHEN abs(llm_estimate - deterministic) <= 30 THEN 'Medium' ELSE 'Low' END AS level FROM k)"
    parts = "string_split(regexp_replace(replace(text, chr(10), ' '), '([.;])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    sents = f"[y FOR y IN [trim(regexp_replace(x, '^\\s*[0-9]+[.)]\\s+', '')) FOR x IN {parts}] IF length(y) >= 20]"
    hit = "SELECT *, 0 AS o, 'license' AS param FROM se WHERE contains(lower(s), 'license') OR contains(lower(s), 'mail') UNION ALL SELECT *, 1, 'token' FROM se WHERE contains(lower(s), 'token') OR contains(lower(s), 'the')"
    cats = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted({"target_brand": "contains(lower(text), lower(brand))"}.items() | {n: has("lower(text)", ws) for n, (ws, _) in PAGE_PACK.items()}.items())) + "], lambda x: x IS NOT NULL), ', ')"
    burden = RESULTS + ", s AS (SELECT brand, " + ", ".join(f"round_even(avg(CASE WHEN regexp_full_match({c}, '[0-9]+') THEN {c}::INT ELSE 0 END) * 10, 0) / 10 AS {n}" for c, n in (("steps_through_brands", "branded"), ("steps_through_generic", "generic"))) + " FROM ruled GROUP BY 1)"
    clean = "array_to_string([trim(x) FOR x IN string_split(text, chr(10))], chr(10))"
    blanks = r"\n\s*\n(\s*\n)+"
    for pattern, to in ((blanks, "\n\n"), (r"[ \t]{2,}", " "), (r"(?m)^(Last Update:.*|Effective:.*Page.*|Page\s*[0-9]+\s*of\s*[0-9]+.*)$", ""), (r"(?m)^\s*[0-9]{1,3}\s*$", ""), (r"(\w) - (\w)", r"\1-\2"), (r"(\w)- (\w)", r"\1-\2"), (r"(\w) -(\w)", r"\1-\2"), (blanks, "\n\n")):
        clean = f"regexp_replace({clean}, {lit(pattern)}, {lit(to)}, 'g')"
    return {
        "document_types": W + " SELECT * FROM dt",
        "doc_type_counts": W + " SELECT document_type, count(*) AS n FROM dt GROUP BY 1",
        "preferred_status": W + ", " + preferred(),
        "universal_boundary": W + f", {boundary()} SELECT * FROM bd",
        "universal_pages": W + f", {boundary()} SELECT filename, page_num, text FROM wp JOIN bd USING (filename) JOIN dt USING (filename) WHERE document_type = 'multi-drug' AND (page_num < boundary OR {late})",
        "context_paragraph": W + f", {paras()} SELECT filename, brand, page_num, ord, para FROM pk WHERE good",
        "section_paragraphs": W + f", {paras()}, q AS (SELECT pk.*, {signal('pl')} AS sig, bool_or(good) OVER (PARTITION BY pk.filename, pk.brand) AS found FROM pk JOIN dt USING (filename) WHERE document_type <> 'single-drug') SELECT filename, brand, page_num, ord, para FROM q WHERE CASE WHEN found THEN good ELSE sig END UNION ALL SELECT filename, brand, page_num, 0, trim(text) FROM tp JOIN dt USING (filename) WHERE document_type = 'single-drug'",
        "param_snippets": W + f", {paras()}, {snippets()}",
        "page_tags": W + f", {tags()} SELECT filename, brand, page_num, tag, score, included FROM ti",
        "renewal_pages": W + f", {tags()} SELECT filename, brand, page_num, (NOT included)::INT AS turn FROM ti WHERE {renew} AND (included OR {disease})",
        "limit_pages": W + f", {tags()} SELECT filename, brand, page_num FROM ti WHERE included AND {has('low', packs.LIMIT_PHRASES)}",
        "drug_mentions": mention_counts(),
        "rule_extract": layout_rules(),
        "layout_gate": f"WITH {sections()} SELECT filename, brand, {' + '.join(f'contains(lower(substring(text, 1, 500)), {lit(m)})::INT' for m in packs.LAYOUT_MARKS)} >= 2 AS laid_out FROM sec",
        "section_ranges": f"WITH {sections()} SELECT * FROM ge",
        "section_texts": f"WITH {sections()} SELECT * FROM sec",
        "section_rules": section_rules(),
        "section_steps": f"WITH {sections()}, {steps_found('sec')}",
        "section_requirements": f"WITH {sections()}, {step_rows('sec')} SELECT * FROM rq",
        "step_patterns": worded() + f", wq AS (SELECT filename, page_num::VARCHAR AS brand, text FROM wp), {step_rows('wq')} SELECT * FROM rq",
        "step_analysis": worded() + f", wq AS (SELECT filename, page_num::VARCHAR AS brand, text FROM wp), {steps_found('wq')}",
        "simple_values": f"WITH {raw()} SELECT filename, brand, trim(age) <> '' AS age, tb_test_required IN ('Y', 'No', 'NA') AS tb_test_required, quantity_limits <> '' AS quantity_limits, specialist_types <> '' AS specialist_types, regexp_full_match(initial_auth_duration, '[0-9]+') OR initial_auth_duration IN ('NA', 'Unspecified', 'No') AS initial_auth_duration, regexp_full_match(reauth_duration, '[0-9]+') OR reauth_duration IN ('NA', 'Unspecified', 'No') AS reauth_duration, reauth_required IN ('Yes', 'No', 'NA') AS reauth_required FROM raw",
        "confidence_counts": conf + " SELECT count(*) FILTER (WHERE level = 'High') AS high, count(*) FILTER (WHERE level = 'Medium') AS medium, count(*) FILTER (WHERE level = 'Low') AS low FROM v",
        "file_brands": f"WITH {TASKS}, f AS (SELECT filename, brand, min(row_no) AS pos FROM tasks GROUP BY 1, 2) SELECT filename, count(*) AS n_brands, string_agg(brand, ', ' ORDER BY pos) AS brands FROM f GROUP BY 1",
        "run_statistics": "SELECT 'p' || (o_orderkey % 3) AS provider, count(*) AS calls, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS hits, (sum(o_orderkey % 9000) // 4)::BIGINT AS tokens FROM orders GROUP BY 1",
        "selected_tasks": f"WITH {TASKS} SELECT row_no, filename, brand FROM tasks WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#8') AND (filename, brand) IN (SELECT (filename, brand) FROM tasks WHERE row_no % 5 <> 0)",
        "filtered_results": RESULTS + "SELECT filename, brand, access_score FROM ruled WHERE brand = 'BRAND#3'",
        "kept_records": f"WITH {RECORDS} SELECT filename, brand, pass_name, provider FROM records WHERE provider = 'groq'",
        "stale_records": f"WITH {RECORDS}, t AS (SELECT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 40) AS brand FROM orders) SELECT filename, brand, pass_name, provider FROM records r WHERE NOT (pass_name = 'validate' AND EXISTS (SELECT 1 FROM t WHERE t.brand < 'Brand#2' AND t.filename = r.filename AND t.brand = r.brand))",
        "record_hits": f"WITH {RECORDS} SELECT DISTINCT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 40) AS brand FROM orders WHERE (o_custkey::VARCHAR, 'Brand#' || (1 + o_orderkey % 40)) IN (SELECT (filename, brand) FROM records)",
        "two_groups": f"WITH {raw()}, {raw(1, 'm')} SELECT filename, brand, " + ", ".join(f"{'a' if p in packs.SIMPLE_PARAMS else 'b'}.{p}" for p in P) + " FROM raw a JOIN m b USING (filename, brand)",
        "low_yield_retry": f"WITH {raw()}, {raw(1, 'm')}, n AS (SELECT *, {n_real} AS k, length({' || '.join(P)}) AS chars FROM raw) SELECT filename, brand, " + ", ".join(f"CASE WHEN k < 9 AND chars <= 150 AND chars % 3 <> 0 AND chars <> 9 AND {na('a.' + p)} AND NOT {na('b.' + p)} THEN b.{p} ELSE a.{p} END AS {p}" for p in P) + " FROM n a LEFT JOIN m b USING (filename, brand)",
        "few_shot": f"WITH {raw()} SELECT filename, brand, CASE brand WHEN 'Brand#1' THEN '1,4' WHEN 'Brand#2' THEN '1,5' ELSE '1,2,3' END AS examples FROM raw",
        "prompts": f"""WITH {raw()}, e AS (SELECT filename, brand, 'EXAMPLES:' || chr(10) || chr(10) || 'Example 1: own record' || chr(10) || '{{"age":"' || age || '","step_therapy_requirements":"' || step_therapy_requirements || '","reauth_requirements":"' || reauth_requirements || '"}}' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Extract the parameters.' || chr(10) || chr(10) || 'DOCUMENT INFO:' || chr(10) || '- Filename: ' || filename || chr(10) || '- Target Brand: ' || brand || chr(10) || '- Document Type: ' || CASE WHEN tb_test_required = 'Y' THEN 'decision-tree' ELSE 'multi-drug' END
  || CASE WHEN quantity_limits NOT IN ('No', '') THEN chr(10) || chr(10) || 'UNIVERSAL CRITERIA:' || chr(10) || quantity_limits ELSE '' END || chr(10) || chr(10) || 'POLICY TEXT:' || chr(10) || specialist_types || '; ' || initial_auth_duration || CASE WHEN tb_test_required = 'Y' THEN chr(10) || chr(10) || 'DECISION TREE:' || chr(10) || 'Follow the tree.' ELSE '' END || chr(10) || chr(10) || 'Return JSON only.' AS prompt FROM raw)
  SELECT filename, brand, length(prompt)::INT AS chars, md5(prompt) AS prompt_md5 FROM e""",
        "chunk_budgets": f"SELECT doc_id, {room('3000 + length(text)', 12000, 2000)} AS with_universal, {room('3000', 12000, 2000)} AS without FROM documents",
        "routes": f"SELECT CASE WHEN length(text) <= {room('3000', 6000, 500)} THEN 'small' WHEN length(text) <= {room('3000', 12000, 2000)} THEN 'large' ELSE 'chunked' END AS route, count(*) AS n FROM documents GROUP BY 1",
        "section_span": f"WITH {TASKS}, {PAGES}, x AS (SELECT t.filename, t.brand, page_num, lower(text) AS low FROM (SELECT DISTINCT filename, brand FROM tasks) t JOIN pages_ USING (filename)), y AS (SELECT *, min(CASE WHEN contains(low, 'the') THEN page_num END) OVER w AS b FROM x WINDOW w AS (PARTITION BY filename, brand)), z AS (SELECT *, min(CASE WHEN contains(low, 'license') AND NOT contains(low, 'the') AND page_num > b THEN page_num END) OVER (PARTITION BY filename, brand) AS e FROM y) SELECT filename, brand, page_num FROM z WHERE page_num >= b AND (e IS NULL OR page_num < e)",
        "sentences": f"SELECT doc_id, (unnest(range(len(s))))::INT AS ord, unnest(s) AS sentence FROM (SELECT doc_id, {sents} AS s FROM documents)",
        "context_sentence": f"WITH {TASKS}, {PAGES}, se AS (SELECT filename, brand, page_num, j::INT - 1 AS sent, a[j] AS s, array_to_string(a[greatest(1, j - 1):j + 1], ' ') AS around FROM (SELECT *, unnest(range(1, len(a) + 1)) AS j FROM (SELECT t.filename, t.brand, page_num, {sents} AS a FROM (SELECT DISTINCT filename, brand FROM tasks) t JOIN pages_ USING (filename)))), hi AS ({hit}), h1 AS (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY filename, brand, substring(around, 1, 100) ORDER BY page_num, o, sent) = 1) SELECT filename, brand, param, page_num, sent, around FROM h1 QUALIFY row_number() OVER (PARTITION BY filename, brand, param ORDER BY page_num, sent) <= 5",
        "step_burden_melt": burden + " SELECT brand, 'branded' AS kind, branded AS steps FROM s UNION ALL SELECT brand, 'generic', generic FROM s",
        "light_validation": f"WITH {raw()}, f AS (SELECT *, (reauth_duration NOT IN ('NA', 'N/A', '') OR reauth_requirements NOT IN ('NA', 'N/A', '')) AND reauth_required <> 'Yes' AS a, reauth_required = 'Yes' AND reauth_duration IN ('NA', 'N/A', '') AS b FROM raw) SELECT filename, brand, CASE WHEN a THEN 'Yes' ELSE reauth_required END AS reauth_required, CASE WHEN b THEN 'Unspecified' ELSE reauth_duration END AS reauth_duration, CASE WHEN a THEN 'reauth_required' WHEN b THEN 'reauth_duration' ELSE '' END AS corrections FROM f",
        "run_totals": sanity().replace("WITH ", "WITH findings AS (WITH ", 1) + f"), tot AS (WITH {raw()}, {norm()}, {scored()}, {ruled()} SELECT sum(CASE WHEN violations = '' THEN 0 ELSE len(string_split(violations, ',')) END)::BIGINT AS n_fixes, count(*) FILTER (WHERE access_score IS NULL) AS n_unscored FROM ruled) SELECT n_fixes, n_unscored, (SELECT count(*) FROM findings) AS n_findings FROM tot",
        "page_profile": f"WITH {SCORED_PAGES} SELECT filename, brand, page_num + 1 AS page, relevance, {cats} AS categories, length(text)::INT AS chars, substring(text, 1, 80) AS preview FROM sp",
        "clean_text": f"SELECT doc_id, trim({clean}) AS text FROM documents",
        "safe_keys": "SELECT DISTINCT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 40) AS brand, o_custkey || '_Brand_' || (1 + o_orderkey % 40) AS key FROM orders",
        "split_failed": f"WITH RECURSIVE hv AS {halved('documents', 'doc_id', 'length(text) > 700')} SELECT doc_id, path, length(text)::INT AS chars, md5(text) AS text_md5 FROM hv WHERE length(text) <= 700",
        "split_given_up": f"WITH RECURSIVE hv AS {halved('documents', 'doc_id', 'length(text) > 700')} SELECT doc_id, path, length(text)::INT AS chars FROM hv WHERE length(text) > 700 AND depth = 3",
        "context_package_page": packages("page", clean),
        "context_package_paragraph": packages("paragraph", clean),
        "context_package_sentence": packages("sentence", clean),
        "dry_run_by_type": f"SELECT document_type, preferred_status, count(*) AS n_tasks, sum(length(full_text))::BIGINT AS chars, (sum(length(full_text)) // 4)::BIGINT AS tokens FROM ({packages('paragraph', clean)}) GROUP BY 1, 2",
        "brand_section": brand_sections(),
        "brand_window": "WITH a AS (SELECT doc_id, text, lower(text) AS low FROM documents) SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, (CASE WHEN regexp_matches(low, '(?m)^\\s*license') THEN length(regexp_extract(low, '(?ms)\\A(.*?)^\\s*license', 1)) + 1 ELSE greatest(strpos(low, 'license'), 1) END)::INT, 2000) END AS text FROM a",
        "context_page": base_sql()["context_pages_adjacent"].replace("SELECT filename, brand, page_num, CASE WHEN ok", "SELECT filename, brand, page_num, text AS t, CASE WHEN ok").replace("WITH ", "WITH tg0 AS (WITH ", 1) + f"), jo AS (SELECT filename, brand, count(*) AS total_pages, count(*) FILTER (WHERE tag <> 'irrelevant') AS pages_used, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_num) FILTER (WHERE tag <> 'irrelevant'), '') AS text FROM tg0 GROUP BY 1, 2) SELECT filename, brand, total_pages, pages_used, {clean} AS text FROM jo",
        "studies": f"WITH {study_texts()} SELECT filename, brand, {study('text')} AS study FROM sx",
        "findings": found_of_all(),
        "finding_counts": f"SELECT kind, \"column\", count(*) AS n FROM ({found_of_all()}) GROUP BY 1, 2",
        "low_confidence": conf + " SELECT filename, brand, llm_estimate, deterministic, level FROM v WHERE level <> 'High'",
        "marked_sections": unfolded("documents", "doc_id", pieces("text", "2000", "\\n[A-Z]"), "ord", "section"),
        "packed_chunks": unfolded("documents", "doc_id", "string_split(list_reduce(string_split(text, chr(10)), lambda acc, x: CASE WHEN length(string_split(acc, chr(1))[-1]) + 1 + length(x) <= 2000 THEN acc || chr(10) || x ELSE acc || chr(1) || x END), chr(1))", "chunk_no", "chunk"),
        "param_snippet": f"WITH fl AS (SELECT doc_id, text, list_filter({SENTENCE_LIST}, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'token') OR contains(lower(x), 'mail')) AS f FROM documents) SELECT doc_id, {within('f', 500)} AS text FROM fl",
        "param_snippet_of": snippets_of(),
        "focused_text": focused_text(),
        "analysis_blocks": analysis_blocks(),
        "paragraphs": f"SELECT doc_id, (j - 1)::INT AS ord, l[j] AS para FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM ({paragraph_list()}))",
        "chunk_rows": f"WITH {chunks()} SELECT filename, brand, chunk_no, chunked, route, length(u)::INT AS universal_chars, length(text)::INT AS chars, md5(text) AS text_md5 FROM ck",
        "chunk_answers": f"WITH RECURSIVE {chunks()}, {chunk_answers()} SELECT * FROM ma",
        "two_group_answers": two_group_answers(),
        "fallback_chain": fallback(),
    }


def sql() -> dict[str, str]:
    return base_sql() | more_sql()


def base_sql() -> dict[str, str]:
    lowered = "lower(text)"
    study = " + ".join(f"len(regexp_extract_all({lowered}, {lit(p)}))" for p in packs.STUDY_PATTERNS)
    policy = " + ".join(f"len(regexp_extract_all({lowered}, {lit(p)}))" for p in packs.POLICY_PATTERNS)
    diff = " UNION ALL ".join(f"SELECT filename, brand, '{p}' AS param, o.{p} AS old_value, n.{p} AS new_value FROM old_ o JOIN raw n USING (filename, brand) WHERE o.{p} IS DISTINCT FROM n.{p}" for p in P)
    na = lambda c: f"(lower(trim({c})) IN {among(packs.GAP_FORMS)})"
    return {
        "raw_params": f"WITH {raw()} SELECT * FROM raw",
        "normalized": f"WITH {raw()}, {norm()} SELECT * FROM norm",
        "access_score": SCORED + "SELECT filename, brand, access_score FROM scored",
        "business_rules": RESULTS + "SELECT * FROM ruled",
        "score_brand_summary": RESULTS + "SELECT brand, count(*) AS n, round_even(avg(access_score), 0)::INT::VARCHAR AS mean_score, min(access_score)::VARCHAR AS min_score, max(access_score)::VARCHAR AS max_score FROM ruled GROUP BY brand",
        "score_histogram": RESULTS + "SELECT access_score, count(*) AS n FROM ruled GROUP BY 1",
        "brand_mean_sorted": RESULTS + "SELECT brand, round_even(avg(access_score), 0)::INT AS mean_score FROM ruled GROUP BY 1",
        "step_burden": RESULTS + ", s AS (SELECT brand, " + ", ".join(f"round_even(avg(CASE WHEN regexp_full_match({c}, '[0-9]+') THEN {c}::INT ELSE 0 END) * 10, 0) / 10 AS {n}" for c, n in (("steps_through_brands", "branded"), ("steps_through_generic", "generic"))) + " FROM ruled GROUP BY 1) SELECT brand, branded, generic, round_even((branded + generic) * 10, 0) / 10 AS total FROM s",
        "kpi_row": RESULTS + ", t AS (SELECT DISTINCT o_custkey::VARCHAR AS filename, 'BRAND#' || (1 + o_orderkey % 40) AS brand FROM orders) SELECT (SELECT count(*) FROM ruled) AS n, (SELECT avg(access_score) FROM ruled) AS mean_score, (SELECT min(access_score) FROM ruled) AS min_score, (SELECT max(access_score) FROM ruled) AS max_score, (SELECT count(DISTINCT brand) FROM ruled) AS n_brands, (SELECT count(*) FROM t) AS n_tasks, (SELECT count(*) FROM t JOIN (SELECT DISTINCT filename, brand FROM ruled) USING (filename, brand)) * 100.0 / (SELECT count(*) FROM t) AS done_pct",
        "score_breakdown": components(),
        "score_confidence": SCORED + ", c AS (SELECT s.filename, s.brand, least(100, greatest(0, estimated_access_score)) AS e, access_score FROM scored s JOIN raw USING (filename, brand)) SELECT filename, brand, CASE WHEN estimated THEN e END AS llm_estimate, access_score AS deterministic, CASE WHEN estimated THEN abs(e - access_score) END AS diff, CASE WHEN NOT estimated THEN 'N/A' WHEN abs(e - access_score) <= 15 THEN 'High' WHEN abs(e - access_score) <= 30 THEN 'Medium' ELSE 'Low' END AS level FROM (SELECT c.*, raw.estimated_access_score IS NOT NULL AS estimated FROM c JOIN raw USING (filename, brand))",
        "score_sanity": sanity(),
        "rescore_changes": RESULTS + ", " + scored("(SELECT * RENAME (access_score AS old_score) FROM ruled)", "again", "filename, brand, old_score") + " SELECT filename, brand, old_score, access_score AS new_score, old_score IS DISTINCT FROM access_score AS changed FROM again",
        "cross_row_consistency": consistency(),
        "distribution_drift": RESULTS + f", {expected_values()}, long AS ({unpivot('ruled')}), t AS (SELECT brand, count(*) AS n FROM ruled GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT brand, \"column\", value, count(*) AS k FROM long GROUP BY 1, 2, 3) SELECT brand, \"column\", value, pct, coalesce(k, 0) * 100.0 / n AS actual_pct FROM expected JOIN t USING (brand) LEFT JOIN c USING (brand, \"column\", value) WHERE abs(coalesce(k, 0) * 100.0 / n - pct) > 25",
        "completeness": f"WITH {raw()} " + " UNION ALL ".join(f"SELECT filename, brand, '{p}' AS \"column\", 'empty' AS kind FROM raw WHERE {p} IS NULL OR trim({p}) = ''" for p in P),
        "expected_vs_actual": f"WITH {TASKS}, a AS (SELECT DISTINCT filename, brand FROM tasks), e AS (SELECT DISTINCT filename, brand FROM tasks WHERE row_no % 5 <> 0 UNION VALUES ('x1', 'A'), ('x2', 'B'), ('x3', 'C')) SELECT *, 'missing' AS kind FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM e)",
        "completion_by_file": f"WITH {RECORDS}, t AS (SELECT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 40) AS brand FROM orders), j AS (SELECT filename, count(*) AS n_tasks, count(r.hit) AS n_done FROM t LEFT JOIN (SELECT DISTINCT filename, brand, 1 AS hit FROM records) r USING (filename, brand) GROUP BY 1) SELECT *, CASE WHEN n_done = n_tasks THEN 'all' WHEN n_done > 0 THEN 'any' ELSE 'none' END AS state FROM j",
        "provider_counts": f"WITH {RECORDS} SELECT provider, count(*) AS n FROM records GROUP BY 1",
        "best_record": f"WITH {RECORDS} SELECT filename, brand, pass_name, provider, {', '.join(P)} FROM records QUALIFY row_number() OVER (PARTITION BY filename, brand ORDER BY CASE pass_name WHEN 'validate' THEN 0 ELSE 1 END, CASE provider WHEN 'groq-optimized' THEN 0 WHEN 'groq' THEN 1 ELSE 2 END) = 1",
        "pending_tasks": f"WITH {RECORDS}, t AS (SELECT DISTINCT o_custkey::VARCHAR AS filename, 'Brand#' || (1 + o_orderkey % 40) AS brand FROM orders) SELECT filename, brand FROM t ANTI JOIN records USING (filename, brand)",
        "record_diff": f"WITH {raw()}, {raw(1, 'old_')} {diff}",
        "merge_records": merge(),
        "fill_gaps": f"WITH {raw()}, {raw(1, 'other')} SELECT filename, brand, " + ", ".join(f"CASE WHEN {na('a.' + p)} AND NOT {na('b.' + p)} THEN b.{p} ELSE a.{p} END AS {p}" for p in P) + " FROM raw a LEFT JOIN other b USING (filename, brand)",
        "rule_priority_merge": f"WITH {raw()}, {raw(1, 'm')} SELECT filename, brand, " + ", ".join((f"coalesce(nullif(a.{p}, 'NA'), b.{p})" if p not in ("step_therapy_requirements", "reauth_requirements") else f"CASE WHEN b.{p} IN ('', 'NA', 'N/A') THEN coalesce(nullif(a.{p}, 'NA'), b.{p}) ELSE b.{p} END") + f" AS {p}" for p in P) + " FROM raw a JOIN m b USING (filename, brand)",
        "first_n_tasks": f"WITH {TASKS} SELECT row_no, filename, brand FROM tasks ORDER BY row_no LIMIT 50",
        "page_relevance": f"WITH {SCORED_PAGES} SELECT filename, brand, page_num, relevance FROM sp",
        "relevance_band": f"WITH {SCORED_PAGES} SELECT CASE WHEN relevance >= 8 THEN 'strong' WHEN relevance >= 3 THEN 'moderate' WHEN relevance > 0 THEN 'weak' ELSE 'none' END AS band, count(*) AS n FROM sp GROUP BY 1",
        "context_reduction": f"WITH {SCORED_PAGES}, r AS (SELECT filename, brand, sum(length(text))::BIGINT AS raw_chars, sum(CASE WHEN relevance >= 1 THEN length(text) ELSE 0 END)::BIGINT AS kept_chars FROM sp GROUP BY 1, 2) SELECT *, CASE WHEN raw_chars = 0 THEN 0.0::DOUBLE ELSE 1 - kept_chars::DOUBLE / raw_chars END AS reduction FROM r",
        "context_pages_adjacent": f"WITH {SCORED_PAGES}, f AS (SELECT *, relevance >= 3 AND (count(*) OVER (PARTITION BY filename, brand) <= 50 OR contains(lower(text), 'license') OR contains(lower(text), lower(brand))) AS ok FROM sp), g AS (SELECT *, coalesce(lag(ok) OVER w, false) OR coalesce(lead(ok) OVER w, false) AS near FROM f WINDOW w AS (PARTITION BY filename, brand ORDER BY page_num)) SELECT filename, brand, page_num, CASE WHEN ok THEN 'relevant' WHEN near THEN 'context' ELSE 'irrelevant' END AS tag FROM g",
        "literature_flag": f"SELECT doc_id, {study} AS n_study, {policy} AS n_policy FROM documents",
        "connector": f"SELECT doc_id, CASE WHEN {has(lowered, packs.AND_MARKERS)} THEN 'AND' WHEN {has(lowered, packs.OR_MARKERS)} THEN 'OR' WHEN n_or > n_and THEN 'OR' WHEN n_and > 0 THEN 'AND' ELSE 'OR' END AS connector FROM (SELECT *, len(regexp_extract_all(lower(text), '\\bor\\b')) AS n_or, len(regexp_extract_all(lower(text), '\\band\\b')) AS n_and FROM documents)",
        "token_budget": "SELECT doc_id, greatest(500, trunc((4000::DOUBLE - length(text) / 1.4::DOUBLE) * 0.95::DOUBLE * 1.4::DOUBLE)::INT) AS chars FROM documents",
        "sliding_chunks": "SELECT doc_id, k::INT AS chunk_no, substring(text, k * 2750 + 1, 3000) AS chunk FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 3000 THEN 1 ELSE ceil((length(text) - 250) / 2750.0)::INT END)) AS k FROM documents)",
        "topk_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 3000 THEN 1 ELSE ceil((length(text) - 250) / 2750.0)::INT END)) AS k FROM documents), s AS (SELECT doc_id, k, substring(text, k * 2750 + 1, 3000) AS chunk, " + " + ".join(f"contains(lower(substring(text, k * 2750 + 1, 3000)), '{w}')::INT" for w in ("license", "token", "mail")) + " AS n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS rn, max(n) OVER (PARTITION BY doc_id) AS best FROM s), h AS (SELECT DISTINCT doc_id, k + unnest([-1, 0, 1]) AS k FROM r WHERE rn <= 8 AND n > 0) SELECT r.doc_id::VARCHAR AS filename, r.k::INT AS chunk_no, r.chunk FROM r LEFT JOIN (SELECT *, true AS hit FROM h) h ON r.doc_id = h.doc_id AND r.k = h.k WHERE h.hit OR (best = 0 AND r.k < 3)",
        "dry_run": f"WITH {TASKS} SELECT count(*) AS n_tasks, sum(length(text))::BIGINT AS chars, avg(length(text)) AS mean_chars, sum(length(text))::BIGINT // 4 AS tokens FROM tasks JOIN documents d ON tasks.filename = d.doc_id::VARCHAR",
        "budget_prefix": "WITH l AS (SELECT doc_id, (unnest(range(len(s))))::INT AS ord, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), w AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT doc_id, count(*)::INT AS n_lines, sum(length(line))::BIGINT AS chars FROM w WHERE before < 1500 GROUP BY 1",
    }
