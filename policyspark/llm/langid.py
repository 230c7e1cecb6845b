"""Language identification by Bayesian fusion of evidence.

P(lang | all) is proportional to P(text | lang)^t P(declared | lang)
P(suffix | lang) P(lang | host):

* text: character trigrams, hashed to ``BUCKETS``, with probabilities counted
  over all rows of a labelled table; the exponent t keeps a long text from
  drowning every other kind of evidence;
* declared: the lang attribute of the page's html element;
* suffix: the last label of the address's host name;
* host: the mean text posterior of its other rows, smoothed towards its
  registered domain's, and that towards all rows', by grouped aggregation.

The tables of evidence come from text posteriors alone, so they need no labels.
A row's own posterior is taken out of every table before it is judged, so its
text counts once.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.llm.bpe import slices
from policyspark.llm.common import bound_batches, join_hot, materialize

BUCKETS = 1 << 14
#: Trigrams beyond which further ones add nothing to the text's weight.
EVIDENCE = 200.0
#: Numbers of a table of languages and buckets, which every task holds (8 bytes each).
MOST_CELLS = 1 << 26
_MARKUP = re.compile(r"(?i)<(script|style|noscript)\b|<!--|<[^>]*>")


def visible_text(html: str) -> str:
    """A page's text without scripts, styles, comments and tags; entities stand for their characters.

    One pass: what a script, style or comment opens and nothing closes is
    hidden to the end, so no part of the page is read twice.
    """
    out, at, low = [], 0, None
    while m := _MARKUP.search(html, at):
        out.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--" or m[1]:
            low = html.lower() if low is None else low
            close = "-->" if m[0] == "<!--" else f"</{m[1].lower()}"
            end = low.find(close, at)
            at = len(html) if end < 0 else end + len(close)
            if m[1] and end >= 0:
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
    out.append(html[at:])
    return unescape(" ".join(out))


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of letters; other characters part words."""
    point = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le"), np.uint32).astype(np.int64)
    point = np.where((point < 65) | ((point > 90) & (point < 97)) | ((point > 122) & (point < 170)), 32, point)
    h = (point[:-2] * 7919 + point[1:-1] * 104729 + point[2:] * 1299709) % BUCKETS
    blank = (point[1:-1] == 32) & ((point[:-2] == 32) | (point[2:] == 32))
    return np.bincount(h[~blank], minlength=BUCKETS)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """All languages of ``docs`` and log P(bucket | language).

    Counts every row with a language; what reaches the driver is one number for
    each language and bucket. More languages than ``MOST_CELLS`` allows raise
    ValueError rather than being left out.
    """
    bound_batches(docs.sparkSession)
    known = [r["lang"] for r in docs.where("lang is not null and lang <> ''").select("lang").distinct().limit(MOST_CELLS // BUCKETS + 1).collect()]
    if len(known) * BUCKETS > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS // BUCKETS} languages: lower BUCKETS or raise MOST_CELLS")
    known.sort()
    if not known:
        return ["und"], np.full((1, BUCKETS), -np.log(BUCKETS))

    def stage(batches):
        counts = np.zeros((len(known), BUCKETS), np.int64)
        place = {g: i for i, g in enumerate(known)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in place and text:
                    counts[place[lang]] += trigrams(text)
        where = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(where[0], pa.int64()), pa.array(where[1], pa.int64()), pa.array(counts[where], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select("lang", "text").mapInArrow(stage, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(known), BUCKETS), 0.5)
    table[rows["lang"].to_numpy(int), rows["bucket"].to_numpy(int)] += rows["n"].to_numpy(float)
    return known, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(rows: DataFrame, logp: np.ndarray, html: bool) -> DataFrame:
    """``rows`` (key columns, then text) with ``ll``, the tempered log-likelihoods, in place of text."""
    bound_batches(rows.sparkSession)
    keys = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(logp)  # languages times buckets

    def stage(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            for a, b in slices(texts):
                out = []
                for t in texts[a:b]:
                    count = trigrams(visible_text(t or "") if html else t or "")
                    n = int(count.sum())
                    used = np.flatnonzero(count)
                    out.append((model[:, used] @ count[used] * min(1.0, EVIDENCE / max(n, 1))).tolist())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(k)).slice(a, b - a) for k in keys), pa.array(out, pa.list_(pa.float64()))], [*keys, "ll"])

    schema = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k != "text") + ", ll array<double>"
    return rows.select(*keys, "text").mapInArrow(stage, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def fuse(rows: DataFrame, languages: list[str], kappa_host: float = 10.0, kappa_domain: float = 20.0, alpha: float = 0.5) -> DataFrame:
    """Adds lang, confidence, text_lang to rows with host, domain, suffix, declared and ll.

    Sums of posteriors come from grouped aggregation as one array each; a row's
    prior is built from them less the row's own posterior.
    """
    k = len(languages)
    rows = rows.withColumn("q", _softmax(F.col("ll")))
    each = [F.sum(F.col("q")[i]) for i in range(k)]
    summed = lambda name: F.array(*each).alias(name)
    host = rows.groupBy("host", "domain", "suffix").agg(summed("h"), F.count("*").alias("size"))
    over = lambda df, key, name: df.groupBy(key).agg(F.array(*[F.sum(F.col("h")[i]) for i in range(k)]).alias(name))
    domain, suffix = over(host, "domain", "d"), over(host, "suffix", "s")
    host = materialize(host.join(domain, "domain").join(suffix, "suffix"), "hosts")
    whole = host.agg(*[F.sum(F.col("h")[i]) for i in range(k)]).first()  # one row
    mass = F.array(*[F.lit(float(m or 0.0)) for m in whole])
    declared = {r[0]: [float(x) for x in r[1]] for r in rows.groupBy("declared").agg(summed("m")).collect()}  # known languages, other, none
    by_tag = F.lit(None).cast("array<double>")
    for tag, m in sorted(declared.items()):
        if tag != "none":
            by_tag = F.when(F.col("declared") == tag, F.array(*[F.lit(x) for x in m])).otherwise(by_tag)

    def plus(a: Column, b: Column, sign: float = 1.0) -> Column:
        return F.zip_with(a, b, lambda x, y: x + F.lit(sign) * y)

    def less(a: Column) -> Column:
        return F.transform(plus(a, F.col("q"), -1.0), lambda x: F.greatest(x, F.lit(0.0)))

    def weight(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda n, x: n + x)

    def smooth(a: Column, above: Column, kappa: float) -> Column:
        return F.zip_with(a, above, lambda x, y: (x + F.lit(kappa) * y) / (weight(a) + F.lit(kappa)))

    joined = join_hot(rows, host, ["host", "domain", "suffix"], "size")
    joined = joined.select("*", *[less(c).alias(f"_{n}") for n, c in (("h", F.col("h")), ("d", F.col("d")), ("s", F.col("s")), ("m", mass), ("t", by_tag))])
    joined = joined.withColumn("_all", F.transform("_m", lambda x: (x + F.lit(alpha)) / (weight(F.col("_m")) + F.lit(alpha * k))))
    joined = joined.withColumn("_dom", smooth(F.col("_d"), F.col("_all"), kappa_domain))
    joined = joined.select("*", smooth(F.col("_h"), F.col("_dom"), kappa_host).alias("_prior"), smooth(F.col("_s"), F.col("_all"), kappa_domain).alias("_suf"))
    # P(suffix | lang) and P(declared | lang), up to factors that all languages share
    evidence = F.zip_with(F.transform("_prior", lambda x: F.log(x)), F.zip_with("_suf", "_all", lambda x, y: F.log(x / y)), lambda x, y: x + y)
    told = F.coalesce(F.zip_with("_t", "_m", lambda x, y: F.log((x + F.lit(alpha)) / (y + F.lit(alpha * (k + 1))))), F.array(*[F.lit(0.0)] * k))
    post = _softmax(plus(plus(F.col("ll"), told), evidence))
    named = F.array(*[F.lit(x) for x in languages])
    best = lambda p: F.element_at(named, F.array_position(p, F.array_max(p)).cast("int"))
    return joined.withColumn("p", post).select("*", best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), best(F.col("q")).alias("text_lang"))


def page_rows(pages: DataFrame, languages: list[str]) -> DataFrame:
    """page_id, host, domain, suffix, declared and text of pages; what is missing is ''."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    tag = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    declared = F.when(tag == "", "none").when(tag.isin(languages), tag).otherwise("other")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), declared.alias("declared"), F.col("html").alias("text"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of every page and every document.

    doc_id (null for pages), page_id (null for documents), host, lang,
    confidence, text_lang. Documents have no address: their source stands for
    the host, and nothing is declared, since their ``lang`` trains the text
    model. Null texts, addresses and attributes are no evidence; a row without
    any gets the overall prior's language. Repeated rows stay; other columns
    are ignored; empty tables give no rows.
    """
    languages, logp = train(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("source:"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), F.lit("none").alias("declared"), "text")
    web = page_rows(pages, languages).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "host", "domain", "suffix", "declared", "text")
    rows = materialize(text_evidence(own, logp, False).unionByName(text_evidence(web, logp, True)), "evidence")
    return fuse(rows, languages).select("doc_id", "page_id", "host", "lang", "confidence", "text_lang")
