"""I-Match fingerprints, from built-in functions only.

The lexicon holds the terms whose share of documents lies in [low, high], that
is, those in a band of inverse document frequency. At most (mean distinct terms
of a document) / low terms can lie in it, whatever the number of documents, so
it is a single bounded array. Each document keeps its distinct terms of that
lexicon, sorted, and hashes them in several randomised subsets of the lexicon:
``SUBSETS`` subsets that hold each term with a chance of 1 in ``RATES``. A term
is known by its 64-bit hash. Shares are those of distinct texts, so copies don't
move a term out of the band. A text with fewer than ``FEW`` terms of the lexicon
is known by subsets of all its own terms instead: for each, the term that comes
first in a random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyspark.llm.common import discard, materialize, shuffle_partitions, text_or_empty

#: Chance (one in ...) with which a subset holds a term, and how many subsets have it.
RATES = ((8, 8), (32, 12), (128, 12))
SUBSETS = [r for r, n in RATES for _ in range(n)]
LOW, HIGH = 0.005, 0.2
FEW = 8
_EMPTY = "--------"
_LEAST = -(2**63)


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct terms: lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row with ``terms``: the sorted hashes of all terms in the band, counted over distinct texts."""
    text = text_or_empty()
    docs = docs.select(text.alias("text")).groupBy(F.sha2(text.cast("binary"), 256).alias("digest")).agg(F.first("text").alias("text"))
    distinct = materialize(docs.select(term_hashes(F.col("text")).alias("own")), "distinct")
    n = distinct.count()
    terms = distinct.select(F.explode("own").alias("term"))
    band = terms.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= max(2, low * n)) & (F.col("df") <= high * n))
    found = materialize(band.agg(F.array_sort(F.collect_list("term")).alias("terms")), "lexicon")
    discard(distinct)
    return found


def within(text: Column, terms: Column) -> Column:
    """The text's terms that the lexicon holds, in the lexicon's order, which is sorted."""
    return F.array_intersect(terms, term_hashes(text))


def fingerprint(text: Column, kept: Column) -> Column:
    """Eight hex digits for each subset, or ``_EMPTY`` where it has no term of ``kept``.

    A text with few terms of the lexicon has 'x' and its ``marks``.
    """
    rates = F.array(*[F.lit(r) for r in SUBSETS])

    def part(k: Column) -> Column:
        chosen = F.filter(kept, lambda t: F.pmod(F.xxhash64(t, k), F.element_at(rates, k + 1)) == 0)
        # a lambda's argument is evaluated once, however often it is used
        return F.element_at(F.transform(F.array(chosen), lambda c: F.when(F.size(c) == 0, _EMPTY).otherwise(F.right(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.lit(8)))), 1)

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1)), part), "")
    return F.when(F.size(kept) >= FEW, whole).otherwise(marks(text))


def marks(text: Column) -> Column:
    """'x' and for each of as many random orders eight hex digits of the text's first term; 'x' alone of a text without terms."""

    def of(terms: Column) -> Column:
        first = lambda k: F.array_min(F.transform(terms, lambda t: F.xxhash64(t, k)))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1)), lambda k: F.right(F.lpad(F.hex(first(k)), 16, "0"), F.lit(8))), "")

    return F.concat(F.lit("x"), F.element_at(F.transform(F.array(term_hashes(text)), of), 1))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty for both; of one kind of fingerprint with the other, 0."""

    def part(x: Column, k: Column) -> Column:
        return F.substring(x, k * 8 + 1, F.lit(8))

    places = F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1))
    x, y = F.ltrim(a, F.lit("x")), F.ltrim(b, F.lit("x"))
    used = F.size(F.filter(places, lambda k: (part(x, k) != _EMPTY) | (part(y, k) != _EMPTY)))
    same = F.size(F.filter(places, lambda k: (part(x, k) == part(y, k)) & (part(x, k) != _EMPTY)))
    apart = (a.startswith("x") != b.startswith("x")) | (x == "") | (y == "")
    return F.when(a == b, 1.0).when(apart | (used == 0), 0.0).otherwise(same / used)


def following(docs: DataFrame) -> DataFrame:
    """key, next_key: the next document in descending order, the first after the last; and ``need``.

    Range partitions number the documents; a window sees one of them, and the
    edges between them are one row each.
    """
    spark = docs.sparkSession
    keys = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("need"))
    dealt = materialize(keys.repartitionByRange(shuffle_partitions(spark), "key").withColumn("part", F.spark_partition_id()), "order")
    edges = dealt.groupBy("part").agg(F.max("key").alias("last"))
    top = edges.agg(F.max("last")).first()[0]
    before = edges.select("part", F.lag("last").over(Window.orderBy("part")).alias("edge"))  # a row for each partition
    inside = F.lag("key").over(Window.partitionBy("part").orderBy("key"))
    return dealt.withColumn("inside", inside).join(before, "part").select("key", F.coalesce("inside", "edge", F.lit(top)).alias("next_key"), "need")


def imatch(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of edited ones, whose last third the next document's start replaces.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty; a text without terms has
    the fingerprint of no terms. Of rows that repeat a doc_id, the next document
    is the one whose start is smallest, and a null doc_id comes last. An empty
    table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), text_or_empty().alias("text"))
    terms = lexicon(docs).scalar()
    order = following(base)
    starts = base.join(order.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), "need"), "key")
    starts = starts.select("for_key", F.substring("text", F.lit(1), F.col("need")).alias("start")).groupBy("for_key").agg(F.min("start").alias("start"))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("start", F.lit(1), cut))
    rows = base.join(starts, base["key"] == starts["for_key"]).select("key", "text", edited.alias("edited"))
    rows = rows.select("*", within(F.col("text"), terms).alias("kept"), within(F.col("edited"), terms).alias("edited_kept"))
    done = rows.select(
        "key",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_kept")).alias("edited_fingerprint"),
        # where the edit changes the kind of fingerprint, both texts are compared by all their terms
        F.when((F.size("kept") < FEW) != (F.size("edited_kept") < FEW), likeness(marks(F.col("text")), marks(F.col("edited")))).alias("mixed"),
    )
    done = materialize(done, "fingerprints")
    after = done.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("key", "next_key")
    pairs = done.join(order.select("key", "next_key"), "key").join(after, "next_key")
    return pairs.select(
        F.when(F.col("key") != _LEAST, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        F.coalesce("mixed", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
