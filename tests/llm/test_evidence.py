"""Fusion of language evidence and likeness of fingerprints, against plain Python; odd rows of both."""

import math
from collections import defaultdict

import pytest

from policyspark.llm import imatch, langid

LANGS = ["de", "en", "fr"]
ROWS = [  # host, domain, suffix, declared, log-likelihoods
    ("a.x.de", "x.de", "de", "de", [-1.0, -3.0, -4.0]),
    ("a.x.de", "x.de", "de", "none", [-2.0, -2.1, -4.0]),
    ("b.x.de", "x.de", "de", "en", [-5.0, -1.0, -4.0]),
    ("b.x.de", "x.de", "de", "other", [0.0, 0.0, 0.0]),
    ("y.com", "y.com", "com", "en", [-3.0, -1.0, -1.1]),
    ("y.com", "y.com", "com", "none", [-9.0, -8.9, -9.1]),
    ("y.com", "y.com", "com", "fr", [-9.0, -8.9, -9.1]),
    ("z.fr", "z.fr", "fr", "none", [-1.0, -1.0, -1.0]),
    ("z.fr", "z.fr", "fr", "fr", [-4.0, -4.0, -0.5]),
    ("", "", "", "none", [0.0, 0.0, 0.0]),
    ("", "", "", "none", [-2.0, -1.0, -3.0]),
    ("source:web", "", "", "none", [-700.0, -701.0, -702.0]),
]


def softmax(logs):
    powers = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(powers) for x in powers]


def fused(kappa_host=10.0, kappa_domain=20.0, alpha=0.5):
    """Each row's posterior from sums over the other rows."""
    k, out = len(LANGS), []
    q = [softmax(r[4]) for r in ROWS]
    for i, (host, domain, suffix, declared, ll) in enumerate(ROWS):
        def total(column, value, i=i):
            rows = [q[j] for j, r in enumerate(ROWS) if j != i and (column is None or r[column] == value)]
            return [sum(x[g] for x in rows) for g in range(k)]

        smooth = lambda a, above, kappa: [(x + kappa * y) / (sum(a) + kappa) for x, y in zip(a, above)]
        every = total(None, None)
        prior_all = [(x + alpha) / (sum(every) + alpha * k) for x in every]
        prior = smooth(total(0, host), smooth(total(1, domain), prior_all, kappa_domain), kappa_host)
        by_suffix = smooth(total(2, suffix), prior_all, kappa_domain)
        told = [0.0] * k if declared == "none" else [math.log((x + alpha) / (y + alpha * (k + 1))) for x, y in zip(total(3, declared), every)]
        out.append(softmax([x + t + math.log(p) + math.log(s / a) for x, t, p, s, a in zip(ll, told, prior, by_suffix, prior_all)]))
    return out


def test_fusion_equals_plain_python(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, host string, domain string, suffix string, declared string, ll array<double>")
    got = {r["i"]: r for r in langid.fuse(rows, LANGS).collect()}
    for i, want in enumerate(fused()):
        assert got[i]["p"] == pytest.approx(want, abs=1e-9)
        assert got[i]["lang"] == LANGS[want.index(max(want))] and got[i]["confidence"] == pytest.approx(max(want))


def test_languages_of_odd_rows(spark):
    """Null, empty and very long texts, repeated rows, no address, columns that clash with internal ones."""
    texts = [None, "", " \n ", "the cat and the dog " * 50_000, "le chat et le chien", "le chat et le chien", "\x00é"]
    docs = spark.createDataFrame([(i if i else None, t, ["en", "fr", None, "en", "fr", "fr", ""][i], "s" if i % 2 else None, "h", [1.0]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, host string, ll array<double>")
    pages = spark.createDataFrame([(1, None, None, "k"), (2, "no scheme", "", "k"), (3, "http://a.fr/", "<html lang='fr'>le chat" + " <p>le chien" * 20_000, "k"), (3, "http://a.fr/", "<!-- " + "x" * 100_000, "k"), (None, "http://A.FR", "<html lang=xx>the dog", "k")], "page_id long, url string, html string, suffix string")
    got = langid.identify(pages, docs).collect()
    assert len(got) == 12 and all(r["lang"] in ("en", "fr") and 0 < r["confidence"] <= 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["page_id"]].append(r["text_lang"])
    assert by[3, None] == ["en"] and by[4, None] == ["fr"] and len(by[None, 3]) == 2 and "fr" in by[None, 3]


def likeness(a, b):
    """Share of equal parts among those that either has."""
    if a == b:
        return 1.0
    if a.startswith("x") != b.startswith("x") or "x" in (a, b):
        return 0.0
    parts = lambda s: [s.lstrip("x")[i : i + 8] for i in range(0, len(s.lstrip("x")), 8)]
    both = [(x, y) for x, y in zip(parts(a), parts(b)) if x != "--------" or y != "--------"]
    return sum(x == y for x, y in both) / len(both) if both else 0.0


def test_likeness_of_edited_and_next_texts(spark):
    rows = {r["doc_id"]: r for r in imatch.imatch(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    order = sorted(rows, reverse=True)
    kinds = 0
    for i, k in enumerate(order):
        r, after = rows[k], rows[order[(i + 1) % len(order)]]
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], after["fingerprint"]))
        if r["fingerprint"].startswith("x") == r["edited_fingerprint"].startswith("x"):
            assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"], r["edited_fingerprint"]))
        else:
            kinds += 1
            assert 0 <= r["near_edited"] <= 1
    assert kinds < len(rows) / 10


def test_fingerprints_of_odd_rows(spark):
    """Null and repeated doc_ids each have a row; equal texts, null and empty among them, have equal fingerprints; a long text is taken whole."""
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [(1, None), (2, ""), (3, "same words here"), (3, "other words"), (3, "same words here"), (None, "b c d"), (None, None), (4, long), (5, " ".join(f"w{i}" if i < 150_000 else f"v{i}" for i in range(200_000)) + " end")]
    table = spark.createDataFrame([(k, t, "z", "z") for k, t in texts], "doc_id long, text string, key string, fingerprint string")
    got = imatch.imatch(table).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((k or 0, len(t or "")) for k, t in texts)
    prints = defaultdict(set)
    for r in got:
        prints[r["n_chars"]].add(r["fingerprint"])
    assert len(prints[0]) == 1 and len(prints[15]) == 1 and prints[len(long)] != prints[len(long) + 4]
    assert imatch.imatch(table.limit(0)).count() == 0
