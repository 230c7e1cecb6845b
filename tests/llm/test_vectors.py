"""Vector codes, url filter and whitening against brute force, with odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from policyspark.llm import queries, url_filter, vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code int, part int, salt int, n int"


def odd_rows(n=60, size=16):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=size).astype("f4").tolist(), i % 4 if i % 5 else None) for i in range(10, n)]
    good = rows[0][1]
    rows += [(1, None, 1), (2, [None, *good[1:]], 1), (3, [float("nan"), *good[1:]], 1), (4, [float("-inf"), *good[1:]], None), (5, [], 1), (6, good[:8], 1)]
    rows += [(10, good, 0), (10, rows[3][1], 0), (None, rows[4][1], None), (None, good, 7)] + [(99, good, 3)] * n
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], SCHEMA)


def usable(rows, scale, size=16):
    return [(k, np.floor(np.array(v, float) * scale).astype(int).tolist(), label) for k, v, label in rows if v and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]


def lloyd(rows, n_parts, n_entries, rounds):
    """Every part against every entry, in plain Python."""
    first = {}
    for k, x, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(k, x)
    width = len(rows[0][1]) // n_parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for x in list(first.values())[:n_entries]] for p in range(n_parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            members = defaultdict(list)
            for _, x, _ in rows:
                members[near(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else e for i, e in enumerate(books[p])]
    coded = []
    for k, x, label in rows:
        found = [near(cut(x, p), books[p]) for p in range(n_parts)]
        coded.append((k, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    sums = defaultdict(int)
    for _, label, _, error in coded:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return books, sorted(map(str, [(*c, sums[c[1]], digest) for c in coded]))


def test_vector_codes_equal_brute_force(spark):
    rows = odd_rows()
    books, want = lloyd(usable(rows, 4096), 8, 16, 6)
    got = vector_codes.compress(frame(spark, rows).repartition(5))
    assert sorted(map(str, map(tuple, got.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()))) == want
    assert {r[0] for r in got.select("vec_id").collect()}.isdisjoint({1, 2, 3, 4, 5, 6})


def test_vector_codes_rounds_and_layers(spark):
    """Residents written anew after every layer give the codebooks of plain rounds; fewer ids than entries give fewer entries."""
    rows = odd_rows()
    x, size = vectors.integer_vectors(frame(spark, rows), 50, ["vec_id", "label"])
    want, _ = lloyd(usable(rows, 50), 4, 16, 5)
    assert vector_codes.fit_codebooks(x, size, 4, 16, 5, replay=1).tolist() == want
    few = usable(rows[:3], 50)
    y, size = vectors.integer_vectors(frame(spark, rows[:3]), 50, ["vec_id", "label"])
    books = vector_codes.fit_codebooks(y, size, 4, 16, 5)
    assert books.tolist() == lloyd(few, 4, 16, 5)[0] and books.shape[1] == 3
    back = {r["vec_id"]: r["x"] for r in vector_codes.decode(vector_codes.encode(y, books), books).collect()}
    assert back == {k: v for k, v, _ in few}  # as many entries as vectors
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(x, size, 3)


def test_vectors_of_empty_tables(spark):
    none = frame(spark, odd_rows()).where("vec_id in (1, 2, 3, 4, 5)")
    assert vector_codes.compress(none).count() == 0 and whitening.whiten(none).count() == 0
    assert vector_codes.compress(none.limit(0)).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vectors.integer_vectors(frame(spark, [(1, [1e30] * 16, 1)]), 4096, ["vec_id"])


@pytest.mark.parametrize("a", [
    np.random.default_rng(0).normal(size=(40, 12)),
    np.random.default_rng(1).normal(size=(40, 20)) * np.logspace(0, -9, 20),
    np.diag([3.0, 3, 3, 2, 2, 1, 1, 0]),
    np.diag(np.full(21, 1.0)) + np.diag(np.full(20, 1e-3), 1),
    np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.full(20, 1.0), 1),
    np.random.default_rng(2).normal(size=(3, 16)),
    np.zeros((4, 4)),
    np.array([[2.0]]),
], ids=["random", "graded", "equal", "close", "pairs", "low rank", "zero", "one"])
def test_qd_solver(a):
    n = a.shape[1]
    r = np.linalg.qr(np.concatenate([a, np.zeros((n, n))]), mode="r")
    diagonal, upper, _ = whitening.bidiagonal(r)
    exact = np.zeros(n)
    exact[: min(a.shape)] = np.linalg.svd(a, compute_uv=False)
    top = max(exact[0], 1e-300)
    assert np.abs(np.sqrt(np.sort(whitening.singular_squares(diagonal, upper))[::-1]) - exact).max() <= 1e-14 * top * n
    squares, rows, total = whitening.directions(r, 4)
    assert len(squares) == min(4, int((exact > 1e-12 * top).sum())) if exact[0] else not len(squares)
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max(initial=0) < 1e-13
    for s, v in zip(squares, rows):
        assert np.linalg.norm(r.T @ (r @ v) - s * v) < 1e-12 * top**2
    assert total == pytest.approx((exact**2).sum(), rel=1e-12)


def test_dqds_keeps_small_values():
    """A graded bidiagonal matrix: its smallest singular values, 1e-40 of the largest, are right to the last digits."""
    diagonal, upper = 10.0 ** -np.arange(0, 44, 4.0), 0.3 * 10.0 ** -np.arange(2, 42, 4.0)
    from decimal import Decimal, getcontext

    getcontext().prec = 120
    product = Decimal(1)
    for v in whitening.singular_squares(diagonal, upper).tolist():
        product *= Decimal(v)
    want = Decimal(1)
    for d in diagonal.tolist():
        want *= Decimal(d) ** 2
    assert abs(product / want - 1) < Decimal("1e-13")


def test_whitening_equals_eigh(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(whitening, "FAN", 2)
    got = whitening.whiten(frame(spark, rows).repartition(7)).toPandas()
    kept = usable(rows, 256)
    x = np.array([v for _, v, _ in kept])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    y = fit - total / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    z = (x - total / n) @ v[:, :4] / np.sqrt(e[:4])
    assert len(got) == 4 * len(kept) and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-12
    for k in range(4):
        own = got[got["component"] == k + 1]
        assert np.allclose(own["explained"], e[k] / e.sum(), rtol=1e-10)
        sign = np.sign((own["whitened"].to_numpy() ** 3).sum() * (z[:, k] ** 3).sum())
        assert np.allclose(np.sort(own["whitened"]), np.sort(sign * z[:, k]), atol=1e-9)
        assert sorted(own["deviation"]) == sorted(((n * x - total) ** 2).sum(axis=1).tolist())


def test_whitening_without_spread(spark):
    one = [(1, [0.5, 0.25, -0.5], 1), (2, [0.5, 0.25, -0.5], None)]
    assert whitening.whiten(frame(spark, one)).count() == 0
    two = whitening.whiten(frame(spark, [*one, (3, [0.25, 0.25, -0.5], 2)])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 12), r["deviation"]) for r in two) == [(1, 1, 1.0, 4096), (2, 1, 1.0, 4096), (3, 1, 1.0, 4096)]


URLS = [None, "", "no scheme", "://", "http://", "HTTP://NET", "http://net", "http://net/", "http://a.NET/x", "http://anet/", "http://net./", "https://www.example.net/en/1?q#f", "https://example.net/en", "https://example.com/de/", "https://m.example.com/DE/x", "ftp://x.org/fr/é", "x://y://net/", "http://example.org/fr/x\ny", "http://" + "a." * 50000 + "net/" + "p/" * 50000, "http://net/" + "x" * 100000, "http://ÄB.Net/", "http://user@net:80/", "http://b.c.net/en/", "http://b.c.net/en/"]
MORE_RULES = [("c.net", "/en", "allow"), ("net", "/en/", "block"), ("NET", "/e", "allow"), ("dup.net", "/", "allow"), ("dup.net", "/", "block"), (None, "/", "block"), ("example.com", "", "allow"), ("y.org", "/fr/é", "block")]


def judged(url, rules):
    """The rule's wording, with every rule tried on every url."""
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


@pytest.mark.parametrize("rules,keys", [(queries.URL_RULES, 1 << 20), (queries.URL_RULES + MORE_RULES, 1 << 20), (queries.URL_RULES + MORE_RULES, 2)])
def test_url_filter_equals_brute_force(spark, rules, keys):
    plain = [(h.lower(), p, v) for h, p, v in rules if h is not None]
    pages = spark.createDataFrame([(i if i else None, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string, could string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), keys=keys).collect()
    assert {(r["page_id"], *r[1:]) for r in got} == {(i if i else None, *judged(u, plain)) for i, u in enumerate(URLS)} and len(got) == len(URLS)


def test_url_filter_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert [r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), otherwise="block").collect()] == ["block", "block"]
    assert [r["page_id"] for r in url_filter.keep_allowed(pages, rules).collect()] == [2]


def test_cascade_is_exact(spark):
    """Weak filters have many false positives; the levels below tell them apart for every key of the universe."""
    universe = spark.range(20000).selectExpr("concat('key', id % 8000) AS key")
    keys = spark.range(1500).selectExpr("concat('key', id * 7) AS key")
    levels = url_filter.cascade(keys, 1500, universe, 8000, below=1, first=2)
    assert len(levels) > 3
    got = {r["key"] for r in universe.where(url_filter.listed(levels, universe["key"])).distinct().collect()}
    assert got == {f"key{i}" for i in range(0, 8000, 7)}
