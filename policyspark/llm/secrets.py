"""Secret scans: patterns propose, a random forest removes false positives.

Built-in functions find candidates and compute features: length, character
transitions, coverage by dictionary words, the path they stand in and the words
next to them. Spark's own random forest is trained on labelled findings, a
table with candidate, before, after, path and label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.common import discard, join_hot, materialize, text_or_empty

#: A run of token characters with a digit in it.
RUN = r"(?<![A-Za-z0-9_+/=.\-])(?=[A-Za-z_+/=.\-]*[0-9])[A-Za-z0-9_+/=.\-]{15,}[A-Za-z0-9_+/=\-]"
#: A quoted value given to a name that promises a secret.
GIVEN = r"(?i)(?:password|passwd|pwd|secret|token|credential|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']([^\"'\s]{8,})[\"']"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,20}PRIVATE KEY-----"
BEFORE, AFTER = 48, 24
MARK = "[SECRET]"
#: Elements of an array that are folded, or places of a text that are cut, together.
BLOCK = 512
#: Rows in which a run of letters stands as a word before it counts as one of the dictionary's.
LEAST_ROWS = 3
#: Words from which made-up findings take their prose.
PROSE = 400
_PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|rk_live_|xox[abpr]-|AIza|eyJ|-----BEGIN)"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, as a lambda's argument is."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, merge) -> Column:
    """Totals of an array of integers from 0 on: before each element, and after the last.

    Folded block by block, since an array that grows by one is copied each time.
    """

    def fold(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda a, v: F.array_append(a, merge(F.element_at(a, -1), v)))

    def of(blocks: Column) -> Column:
        heads = fold(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), merge)), F.lit(0))
        return _bind(heads, lambda h: F.array_append(F.flatten(F.transform(blocks, lambda b, k: F.slice(fold(b, F.get(h, k)), 1, F.size(b)))), F.element_at(h, -1)))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return _bind(values, lambda v: F.when(F.size(v) == 0, F.array(F.lit(0))).otherwise(_bind(cut(v), of)))


def _places(pattern: str, group: int = 0) -> Column:
    """(start, candidate, before, after) of every match in ``text``; a group must end one character before its match does.

    The text is parted at its matches. The lengths of parts and matches add up
    to the places, and what stands around a match is put together from the parts
    and matches next to it, so work is linear in the text.
    """
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    close = 1 if group else 0

    def found(x: Column) -> Column:
        parts, wholes, values = x["parts"], x["wholes"], x["values"]
        ends = _running(F.transform(wholes, lambda w, i: F.length(F.get(parts, i)) + F.length(w)), lambda a, n: a + n)

        def place(at: Column):
            def of(c: Column, i: Column) -> Column:
                w = F.get(wholes, i)
                # a match has eight characters or more, so these reach BEFORE and AFTER wherever the text does
                left = [y for k in range(-(-BEFORE // 8), 0, -1) for y in (F.right(F.get(parts, i - k), F.lit(BEFORE)), F.right(F.get(wholes, i - k), F.lit(BEFORE)))]
                left += [F.right(F.get(parts, i), F.lit(BEFORE)), F.substring(w, F.lit(1), F.length(w) - F.length(c) - close)]
                right = [F.right(w, F.lit(close))] if close else []
                right += [y for k in range(1, -(-AFTER // 8) + 1) for y in (F.left(F.get(parts, i + k), F.lit(AFTER)), F.left(F.get(wholes, i + k), F.lit(AFTER)))]
                return F.struct(
                    (F.get(at, i + 1) - F.length(c) - close).alias("start"),
                    c.alias("candidate"),
                    F.right(F.concat_ws("", *left), F.lit(BEFORE)).alias("before"),
                    F.left(F.concat_ws("", *right), F.lit(AFTER)).alias("after"),
                )

            return F.transform(values, of)

        return _bind(ends, place)

    return _bind(F.struct(F.split("text", pattern, -1).alias("parts"), whole.alias("wholes"), value.alias("values")), found)


def places(text: Column) -> Column:
    """Every candidate of the column ``text`` once a place, by place, or null where there is none; patterns run once."""
    every = F.sort_array(F.concat(_places(PEM), _places(RUN), _places(GIVEN, 1)))
    other = lambda f, g: g.isNull() | (f["start"] != g["start"]) | (f["candidate"] != g["candidate"])
    return F.when(has_candidate(text), _bind(every, lambda e: F.filter(e, lambda f, i: other(f, F.get(e, i - 1)))))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, candidate, start (0-based code point), before, after and path, once per row, string and place.

    A null text has no candidates; ``path`` is the document's source, and
    ``text_key`` a hash that tells apart texts of rows that repeat a doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), text_or_empty().alias("text"))
    return _each(rows.withColumn("found", places(F.col("text"))))


def _each(rows: DataFrame) -> DataFrame:
    """Candidates of rows with doc_id, path, text and ``found``; a text is hashed before its candidates become rows."""
    rows = rows.select("doc_id", "path", F.xxhash64("text").alias("text_key"), "found")
    # a test of ``found`` itself would be pushed below and search every text twice
    rows = rows.select("doc_id", "text_key", "path", F.explode_outer("found").alias("f")).where("f is not null")
    return rows.select("doc_id", "text_key", "path", "f.candidate", F.col("f.start").cast("long").alias("start"), "f.before", "f.after")


def has_candidate(text: Column) -> Column:
    return text.rlike(RUN) | text.rlike(GIVEN) | text.rlike("-----BEGIN ")


def dictionary(docs: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """w and n: all words of four letters or more that stand in at least ``least`` rows, counted over all texts."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_or_empty()), r"[^\p{L}]+"))).alias("w")).where(F.length("w") >= 4)
    return materialize(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least), "dictionary")


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``cover``, the letters of each candidate that lie in runs which are words of the dictionary.

    Runs of letters don't overlap, so no letter counts twice. Distinct
    candidates meet the dictionary by a shuffle, whatever its size, and a
    candidate that very many rows hold doesn't burden one task.
    """
    each = materialize(found.groupBy("candidate").agg(F.count("*").alias("n")), "strings")
    runs = each.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("w"))
    known = runs.join(words.select("w"), "w").groupBy("candidate").agg(F.sum(F.length("w")).alias("cover"))
    covers = materialize(each.join(known, "candidate", "left").select("candidate", "n", F.coalesce("cover", F.lit(0)).alias("cover")), "covers")
    discard(each)
    return join_hot(found, covers, ["candidate"], "n")


def features() -> Column:
    """Feature array of a row with candidate, before, after, path and cover."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    low, before, after = F.lower("candidate"), F.lower("before"), F.lower("after")
    flag = lambda x: x.cast("double")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    values = [
        F.log1p(n.cast("double")),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share(r"[^A-Za-z0-9]"),
        # character transitions: from letters to digits and back, between cases, between vowels and consonants
        share(r"(?<=[A-Za-z])[0-9]"),
        share(r"(?<=[0-9])[A-Za-z]"),
        share(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        share(r"(?i)(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]|(?<=[bcdfghjklmnpqrstvwxyz])[aeiou]"),
        share(r"(?<=[0-9])[0-9]"),
        share(r"(?i)(?<=[g-z])[g-z]"),
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40)),
        flag(c.rlike(r"(?i)^[0-9a-f]+$")),
        flag(c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        flag(c.rlike(r"^[0-9.\-]+$")),
        flag(c.rlike(_PREFIXES)),
        flag(low.rlike(r"^(password|passwd|pwd|secret|token|credential|api_?key|access_?key)=")),
        flag(low.rlike(r"example|sample|placeholder|your|dummy|changeme|x{6}|0{8}|12345678|(.)\1{7}")),
        F.least(F.lit(1.0), F.col("cover") / n),
        # path
        flag(F.contains(c, F.lit("/"))),
        flag(before.rlike(r"(/|https?:\S*|\\)$")),
        flag(F.lower("path").rlike(r"test|fixture|example|sample|mock|doc/")),
        # neighbouring words
        flag(before.rlike(r"(password|passwd|pwd|secret|token|credential|api.?key|access.?key|auth|bearer)\W{0,6}$")),
        flag(before.rlike(r"password|passwd|secret|token|credential|api.?key|access.?key|private|bearer")),
        flag(before.rlike(r"[:=]\s{0,2}[\"']?$")),
        flag(before.rlike(r"[\"']$")),
        flag(after.rlike(r"^[\"']")),
        flag(before.rlike(r"\b(commit|sha-?[0-9]*|md5|hash|digest|checksum|integrity|rev|revision|uuid|guid|id|isbn|issn|phone|card|order|invoice|version|build|date|crc)\b\W{0,6}$")),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def labelled_findings(spark: SparkSession, words: list[str], n: int = 6000) -> DataFrame:
    """Default training table: labelled findings of common forms among the corpus' own words.

    ``n`` bounds it. A caller with findings of its own passes those instead.
    Random strings given to a secret's name are secrets, the same strings after
    neutral words are not; no finding assigns 40 hex digits to a ``token``, so
    that pairing is left for the forest to infer.
    """
    i = F.col("id")
    salted = lambda s: F.concat(i.cast("string"), F.lit(s))
    hex40, hex64, hex32 = F.sha1(salted("a")), F.sha2(salted("b"), 256), F.md5(salted("c"))
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(salted("d"), 256))), r"[+/=]", "x")
    base64 = F.regexp_replace(F.base64(F.unhex(F.sha2(salted("e"), 256))), "=", "")
    upper = F.upper(F.translate(F.substring(hex64, 1, 16), "0189abcdef", "GHJKLMNPQR"))
    digits = F.translate(F.substring(hex32, 1, 16), "abcdef", "492857")
    cut = lambda x, k: F.substring(x, 1, k)
    many = F.array(*[F.lit(w) for w in (words or ["lorem", "ipsum"])])
    word = lambda s: F.element_at(many, (F.pmod(F.xxhash64(salted(s)), F.size(many)) + 1).cast("int"))
    prose = F.concat_ws(" ", word("p"), word("q"), word("r"))
    uuid = F.concat_ws("-", cut(hex32, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 4), F.substring(hex32, 17, 4), F.substring(hex32, 21, 12))

    def pick(s: str, *texts: str) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(F.xxhash64(salted(s)), F.lit(len(texts))) + 1).cast("int"))

    given = pick("g", ' token = "', ' api_key = "', ' secret: "', ' TOKEN = "', ' access_key="', ' auth_token: "', ' password = "')
    named = pick("g", ' api_key = "', ' secret: "', ' access_key="', ' credential: "', ' password = "')
    forms = [
        (1, hex40, named, '"'),
        (1, F.upper(hex40), named, '"'),
        (1, hex32, given, '"'),
        (1, hex64, given, '"'),
        (1, cut(mixed, 32), given, '"'),
        (1, F.concat(F.lit("AKIA"), upper), pick("h", " aws_access_key_id = ", " key ", " "), ""),
        (1, cut(base64, 40), pick("i", " aws_secret_access_key = ", ' secret_access_key = "'), ""),
        (1, F.concat(F.lit("ghp_"), cut(mixed, 36)), pick("j", " ", " token ", " https://"), ""),
        (1, F.concat(F.lit("sk_live_"), cut(mixed, 24)), pick("k", ' api_key = "', " "), ""),
        (1, F.concat(F.initcap(word("l")), cut(digits, 3), F.lit("!"), cut(mixed, 4)), pick("m", ' password = "', ' passwd: "'), '"'),
        (1, F.concat(F.lit("eyJ"), cut(mixed, 30), F.lit("."), cut(base64, 43)), pick("n", " bearer ", ' token = "'), ""),
        (1, F.concat(pick("A", "passwd=", "secret=", "api_key=", "access_key=", "password="), cut(hex32, 20)), F.lit(" "), ""),
        (1, F.concat(pick("B", "pwd=", "credential=", "token=", "password="), cut(mixed, 16)), F.lit(" "), ""),
        (0, F.concat(pick("C", "page=", "ref=", "version=", "id=", "size="), cut(hex32, 18)), pick("D", " ", " /?", " "), ""),
        (0, hex40, pick("o", " commit ", " sha1 ", " revision ", ' digest = "', " checksum: "), ""),
        (0, hex64, pick("s", " sha256 ", " digest ", " hash: "), ""),
        (0, hex32, pick("t", " md5 ", " ", " checksum "), ""),
        (0, digits, pick("u", " ", " card ", " order ", " phone "), ""),
        (0, uuid, pick("v", " id ", " ", ' uuid = "', " request "), ""),
        (0, F.concat_ws("/", F.lit("usr"), word("w"), F.concat(word("x"), cut(digits, 2)), word("y")), pick("z", " /", " ", " see /"), ""),
        (0, F.concat(F.concat_ws("_", word("1"), word("2"), word("3")), F.lit("_v"), cut(digits, 2)), pick("4", " ", ' name = "', " token "), ""),
        (0, F.concat(cut(digits, 4), F.lit("-05-12-"), F.concat_ws("-", word("5"), word("6"))), pick("7", " https://www.example.com/", " "), ""),
        (0, F.concat(F.lit("YOUR_API_KEY_"), cut(digits, 6)), given, '"'),
        (0, F.concat(F.lit("xxxxxxxxxxxx"), cut(digits, 8)), given, '"'),
        (0, F.concat(word("8"), word("9"), word("0"), cut(digits, 2)), pick("!", " ", ".", "-"), ""),
    ]
    path = F.concat(F.lit("src"), F.pmod(i, F.lit(20))).alias("path")
    parts = []
    for k, (label, candidate, before, after) in enumerate(forms):  # each form in a small projection of its own
        rows = spark.range(k, n, len(forms), 1)
        parts.append(rows.select(path, candidate.alias("candidate"), F.concat(prose, before).alias("before"), F.concat(F.lit(after), F.lit(" "), word("=")).alias("after"), F.lit(float(label)).alias("label")))
    found = reduce(DataFrame.union, parts)
    return materialize(found, "findings")


def train(findings: DataFrame, words: DataFrame, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    rows = findings.where(F.col("candidate").isNotNull() & F.col("label").isNotNull())
    taught = materialize(covered(rows, words).select(features().alias("x"), F.col("label").cast("double").alias("y")), "training")
    rows = taught.select(array_to_vector("x").alias("x"), "y").repartition(1).sortWithinPartitions("y", vector_to_array("x"))  # a bounded table, in an order of its own
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=42, maxMemoryInMB=64).fit(rows)
    discard(taught)
    return model


def judge(found: DataFrame, model: RandomForestClassificationModel, words: DataFrame, least: float = 0.5) -> DataFrame:
    """``found`` with score and is_secret."""
    model.setFeaturesCol("x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("prob")
    scored = model.transform(covered(found, words).withColumn("x", array_to_vector(features())))
    return scored.withColumn("score", vector_to_array("prob")[1]).withColumn("is_secret", F.col("score") >= least).drop("x", "prob", "cover")


def _taught(docs: DataFrame, findings: DataFrame | None) -> tuple[DataFrame, RandomForestClassificationModel]:
    words = dictionary(docs)
    if findings is not None:
        return words, train(findings, words)
    prose = [r["w"] for r in words.where("length(w) <= 12").orderBy(F.desc("n"), "w").limit(PROSE).collect()]
    made = labelled_findings(docs.sparkSession, prose)
    model = train(made, words)
    discard(made)
    return words, model


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Every candidate of every whole text, with the forest's verdict.

    doc_id, start, length, kind, candidate, score, is_secret. Null and empty
    texts and empty tables have none; repeated rows are reported once each; a
    string that a text repeats is reported and judged at each of its places.
    Columns besides doc_id, source and text are ignored.
    """
    words, model = _taught(docs, findings)
    c = F.col("candidate")
    kind = F.when(c.startswith("-----BEGIN"), "private_key").when(c.rlike("^(AKIA|ASIA)"), "cloud_key").when(c.rlike("^(gh[pos]_|glpat-)"), "forge_token").when(c.rlike("^eyJ"), "jwt").when(c.rlike("(?i)^[0-9a-f]+$"), "hex").otherwise("generic")
    return judge(materialize(candidates(docs), "candidates"), model, words, least).select("doc_id", "start", F.length("candidate").cast("long").alias("length"), kind.alias("kind"), "candidate", "score", "is_secret")


def _without(text: Column, spans: Column) -> Column:
    """``text`` with ``MARK`` for each of its sorted spans; spans that overlap share one.

    A block of spans is cut out of the text first and its pieces out of that, as
    finding a place takes time that grows with what stands before it.
    """

    def pieces(ends: Column, of: Column) -> Column:
        def block(k: Column) -> Column:
            at = F.get(ends, k * BLOCK)

            def cut(part: Column) -> Column:
                gap = lambda f, end: F.when(f["start"] >= end, F.concat(F.substring(part, end - at + 1, f["start"] - end), F.lit(MARK))).otherwise("")
                return F.array_join(F.zip_with(F.slice(of, k * BLOCK + 1, BLOCK), F.slice(ends, k * BLOCK + 1, F.least(F.lit(BLOCK), F.size(of) - k * BLOCK)), gap), "")

            last = F.get(of, F.least((k + 1) * BLOCK, F.size(of)) - 1)["start"]
            return _bind(F.substring(text, at + 1, F.greatest(last - at, F.lit(0))), cut)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / BLOCK).cast("int")), block), "")

    whole = lambda ends: F.concat(pieces(ends, spans), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    return _bind(_running(F.transform(spans, lambda f: f["end"]), lambda a, n: F.greatest(a, n)), whole)


def redact(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret replaced by ``MARK``; rows, columns and order of columns stay.

    A string that is a secret at one place of a text is replaced at all places
    where it stands as a candidate, but not inside longer ones. Rows that repeat
    a doc_id are told apart by their texts. n_chars, where there is one, follows
    a changed text. Null texts stay null, an empty table stays empty, and other
    columns are untouched, whatever their names. Patterns run once over a text,
    and texts without candidates are not shuffled.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), text_or_empty().alias("text"))
    rows = materialize(rows.withColumn("found", places(F.col("text"))).drop("text").withColumn("text", F.col(own["text"])), "located")
    words, model = _taught(docs, findings)
    judged = judge(materialize(_each(rows), "candidates"), model, words, least)
    key = ["doc_id", "text_key"]
    strings = judged.groupBy(*key, "candidate").agg(F.max("is_secret").alias("hit"), F.collect_set(F.col("start").cast("int")).alias("starts")).where("hit")
    strings = strings.select(*key, F.explode("starts").alias("start"), F.length("candidate").alias("n"))
    spans = strings.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    some = rows.where("found is not null").drop("found").withColumn("text_key", F.xxhash64("text"))
    some = some.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    clean = _without(F.col("text"), F.col("spans"))
    hit = F.col("spans").isNotNull()
    some = some.withColumn(own["text"], F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in own:
        size = own["n_chars"]
        some = some.withColumn(size, F.when(hit, F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)))
    names = list(own.values())
    return rows.where("found is null").select(*names).unionByName(some.select(*names)).toDF(*docs.columns)
