"""Dictionaries as tables (1.4), and the join of texts with the phrases of one.

A text is cut into its words once, whatever the size of the dictionary. Each phrase
has an anchor that every text with the phrase must have too: its longest word, or where
a phrase may also stand inside longer words, three letters of that word. Texts
and phrases meet on anchors by an equi-join, and only pairs that met are
compared. Phrases without three letters in a row have the empty anchor, which every
text has, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark import packs
from policyspark.functions.normalize import strip

#: Phrases of a dictionary up to which it is sent to every task; larger ones are shuffled by anchor.
SMALL = 20_000
#: Phrases that are looked for one by one: so few cost less than a text's cutting into letters, with the same result.
FEW = 200
GRAM = 3


def values(spark: SparkSession, names: str, rows: Iterable[tuple]) -> DataFrame:
    """A small table of literals, of which Spark knows the size."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)} AS t({names})")


def drug_dim(spark: SparkSession) -> DataFrame:
    """phrase, classification and ord of every drug name that counts as a step."""
    from policyspark.functions.extract import drug_classes

    return values(spark, "phrase, classification, ord", [(d, k, i) for i, (d, k) in enumerate(drug_classes().items())])


def alias_dim(spark: SparkSession) -> DataFrame:
    """brand (upper case) and phrase of the names that a policy's section can have for a brand."""
    return values(spark, "brand, phrase", [(b, a.lower()) for b, names in packs.DRUG_ALIASES.items() for a in names])


def generic_dim(spark: SparkSession) -> DataFrame:
    return values(spark, "brand, phrase", packs.BRAND_GENERIC.items())


def canonical_dim(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """What a page can call a brand, and the brand that each name stands for."""
    return values(spark, "phrase, stands_for", (names or packs.CANONICAL).items())


def keyword_dim(spark: SparkSession, keywords: dict[str, tuple[list[str], float]] | None = None) -> DataFrame:
    """category, phrase and weight of the words that make a page relevant."""
    return values(spark, "category, phrase, weight", [(c, w, float(weight)) for c, (words, weight) in (keywords or packs.PAGE_KEYWORDS).items() for w in words])


def param_keyword_dim(spark: SparkSession) -> DataFrame:
    return values(spark, "param, phrase", [(p, w) for p, words in packs.PARAM_KEYWORDS.items() for w in words])


def _words(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?U)(\w{{{GRAM},}})"), F.lit(1)))


def _longest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]


def _grams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - GRAM + 1), lambda i: F.substring(word, i, F.lit(GRAM)))


def stands_as_word(low: Column, phrase: Column) -> Column:
    return F.rlike(low, F.concat(F.lit(r"\b\Q"), phrase, F.lit(r"\E\b")))


def phrases_in(texts: DataFrame, dictionary: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """A row for each text (``keys``, ``text``) and each entry (``phrase`` in lower case, ...) whose phrase is in it.

    ``whole``: only where it stands as words of its own. Entries that share a phrase
    are found each. The result has ``keys``, ``text`` and the entry's columns. Null texts have no phrases.
    """
    low = F.lower("text")
    parts = _words(low)
    anchors = parts if whole else F.array_distinct(F.flatten(F.transform(parts, _grams)))
    word = _longest(_words(F.col("phrase")))
    entries = dictionary.where("phrase is not null and phrase <> ''").withColumn("_anchor", F.coalesce(word if whole else F.substring(word, 1, GRAM), F.lit("")))
    found = stands_as_word(low, F.col("phrase")) if whole else F.contains(low, F.col("phrase"))
    cut = texts.where("text is not null").withColumn("_anchor", F.explode(F.concat(anchors, F.array(F.lit("")))))
    size = dictionary.count()
    if size <= FEW and not whole:
        known = F.array(*[F.lit(r[0]) for r in entries.select("phrase").distinct().collect()]).cast("array<string>")
        inside = F.element_at(F.transform(F.array(low), lambda t: F.filter(known, lambda p: F.contains(t, p))), 1)  # lower case once a text
        return texts.where("text is not null").withColumn("phrase", F.explode(inside)).join(F.broadcast(entries), "phrase").drop("_anchor")
    if size <= SMALL:
        met = cut.join(F.broadcast(entries), "_anchor")
    else:  # texts stay behind until it is known which phrases they could have
        pairs = cut.select(*keys, "_anchor").join(entries, "_anchor")
        met = texts.join(pairs, keys)
    return met.where(found).drop("_anchor")


def places(texts: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Every place where a phrase of the dictionary stands as words of its own: ``keys``, the entry's columns, ``start`` (from 0), ``end`` and ``context``, the 100 characters on both sides."""
    hits = phrases_in(texts, dictionary, keys, whole=True)
    n = F.length("phrase")
    between = F.transform(F.split(F.lower("text"), F.concat(F.lit(r"\b\Q"), F.col("phrase"), F.lit(r"\E\b"))), F.length)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    starts = F.aggregate(between, none, lambda a, p: F.struct((a["at"] + p + n).alias("at"), F.array_append(a["found"], a["at"] + p).alias("found")), lambda a: F.slice(a["found"], 1, F.size(a["found"]) - 1))
    at = F.col("start")
    around = F.substring(F.col("text"), F.greatest(at - 99, F.lit(1)), F.least(at, F.lit(100)) + n + 100)
    rows = hits.withColumn("start", F.explode(starts)).withColumn("end", at + n)
    return rows.withColumn("context", strip(F.translate(around, "\n", " "))).drop("text")
