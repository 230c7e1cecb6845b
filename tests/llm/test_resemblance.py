"""Near copies by shingle similarity, held against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyspark.llm import resemblance, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, u long, key string"


def words_of(text, size=5):
    words = (text or "").encode().lower().split()  # A-Z and ASCII white space only
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) > 0


def survivors(rows):
    """Smallest doc_id of each group of texts of similarity 0.8, by all pairs; close fingerprints alone don't count."""
    low, sets = list(range(len(rows))), [words_of(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) and low[i] != low[j]:
                a, b = max(low[i], low[j]), min(low[i], low[j])
                low = [b if x == a else x for x in low]
    return {rows[i][0] for i in range(len(rows)) if low[i] == i}


def made(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), i, "k") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng, out = np.random.default_rng(5), []
    for n in (6, 9, 12, 60, 120, 400):
        for _ in range(8):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            out.append(" ".join(base))
            for edits in (0, 1, max(1, n // 60), n // 8):  # the last lies below the similarity
                some = list(base)
                for at in rng.integers(0, n, edits):
                    some[at] = f"x{rng.integers(0, 5000)}"
                out.append(" ".join([*some, "tail"]))
    return out


def test_against_all_pairs(spark, texts):
    got = simhash.drop_near_copies(made(spark, texts))
    assert {r["doc_id"] for r in got.collect()} == survivors(list(enumerate(texts)))


def test_large_group_gives_few_pairs(spark):
    base = " ".join(f"w{i}" for i in range(300))
    group = made(spark, [f"{base} n{i}" for i in range(600)])
    assert resemblance.candidates(group).count() < 20 * 600
    assert [r["doc_id"] for r in simhash.drop_near_copies(group).collect()] == [0]


def test_shared_passage_is_no_near_copy(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    group = made(spark, [f"{passage} " + " ".join(f"d{k}x{i}" for i in range(60)) for k in range(50)])
    assert simhash.drop_near_copies(group).count() == 50


def test_odd_rows(spark):
    odd = made(spark, [None, "", " \n", "a", "a b c", "a b c", "same words here " * 5000])
    odd = odd.union(spark.createDataFrame([(None, "b", None, None, 1, 1, "k"), (3, "a", "en", "s", 1, 1, "k")], SCHEMA))
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [0, 3, 3, 4, 6]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.drop_near_copies(odd.limit(0)).count() == 0
    assert resemblance.similar_pairs(odd.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("block", [128, 16])
def test_original_amid_its_copies_ids(spark, block, monkeypatch):
    """Copies are like the original only, which is neither the lowest of its keys nor of their parts."""
    monkeypatch.setattr(resemblance, "BLOCK", block, raising=False)
    rng = np.random.default_rng(11)
    for n in (11, 31, 101):
        base, group = [f"w{i}" for i in range(400)], []
        for k in range(n):
            some = list(base)
            for at in range(5, 395, 56) if k != n // 2 else ():
                some[at + int(rng.integers(0, 50))] = f"c{k}x{at}"
            group.append(" ".join(some))
        sets = [words_of(t) for t in group]
        assert all(alike(sets[k], sets[n // 2]) for k in range(n)) and not alike(sets[0], sets[1])
        links = resemblance.similar_pairs(made(spark, group))
        assert simhash.contract(links).where("v = 0").select("u").distinct().count() == n - 1


def test_close_fingerprints_alone_are_no_copies(spark):
    """One repeated line rules the fingerprints of texts that share nothing else."""
    line = " same menu line of every single page" * 200
    group = [" ".join(f"d{k}x{i}" for i in range(300)) + line for k in range(3)]
    prints = simhash.simhash_texts(group).view(np.uint64)
    assert all(np.bitwise_count(prints[k] ^ prints[0]) <= 3 for k in range(3))
    group.append(group[1] + " end")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(made(spark, group)).collect()) == [0, 1, 2]
