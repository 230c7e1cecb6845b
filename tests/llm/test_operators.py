"""Corpus operators against brute force, round trips and odd rows."""

import hashlib
import time
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from policyspark.llm import bpe, chat, codec, exact_dedup, imatch, langid, memo, packing, quality, queries, secrets, simhash, token_files

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n", "a", "a", "A  a\ta", "x<|endoftext|>y  z", "same words here " * 40, "same words here " * 40, "été " * 3000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end']


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, ties of doc_id, and a column that clashes with internal names."""
    rows = [(i, t, "en", "s", len(t or ""), "k") for i, t in enumerate(ODD)] + [(3, "a", "en", None, 1, "k"), (None, "b", None, "s", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(name))


def le(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(docs, name):
    texts = [t or "" for t in ODD] + ["İ ΑΣ é", "x\x1cy !\x1c!", "I'll 'S", "日本　語", " a  <|endoftext|> "] + [r["text"] or "" for r in docs.collect()]
    want = [le(e.ids) for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]
    assert memo.encoder(queries.vocabulary(name)).encode(texts) == want


def test_bpe_equals_library(spark, docs, odd):
    path, lib = queries.vocabulary("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    for table in (docs.select("doc_id", "text"), odd):
        rows = bpe.decode_bpe(bpe.encode_bpe(table, path), path).collect()
        assert sorted((r["doc_id"] or -1, r["ids"], r["text"]) for r in rows) == sorted(
            (r["doc_id"] if r["doc_id"] is not None and r["doc_id"] else r["doc_id"] or -1, le(i := lib.encode(r["text"] or "", add_special_tokens=False).ids), lib.decode(i, skip_special_tokens=False)) for r in table.collect()
        )


@pytest.mark.parametrize("ids", [[], [7], [5] * 5000, list(range(70000)), [2**31 - 1, 0, 3]])
def test_codec_round_trip(ids):
    blocks = codec.encode_blocks(np.array(ids))
    assert [x for b in codec.decode_blocks(blocks) for x in b] == ids
    if ids:
        broken = bytearray(blocks[0])
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            codec.decode_blocks([bytes(broken)])


def test_codec_beats_zlib(spark, monkeypatch):
    """Blocks of the default size are smaller than zlib's, and a long stream is coded in groups of lanes."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()]
    ids = np.frombuffer(b"".join(memo.encoder(queries.vocabulary("word_bpe_49k.json")).encode(texts)), "<u4")
    monkeypatch.setattr(codec, "LANES", 7)
    blocks = codec.encode_blocks(ids)
    assert len(blocks) > 7 and np.array_equal(np.concatenate(codec.decode_blocks(blocks)), ids)
    parts = [ids[i : i + codec.BLOCK] for i in range(0, len(ids), codec.BLOCK)]
    assert sum(map(len, blocks)) < 0.93 * sum(len(zlib.compress(p.astype("<u2").tobytes(), 9)) for p in parts)
    assert codec.decode_blocks(blocks[3:5])[1].tolist() == parts[4].tolist()  # a block needs no other


def test_codec_cost():
    """Coding and decoding an id take under 2 microseconds of a usual CPU, within a tenth of the order-0 entropy of ids without contexts."""
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 1 << 20), 1500)
    spins = []
    for _ in range(9):
        began = time.thread_time()
        sum(range(50_000))
        spins.append((time.thread_time() - began) * 1000)
    slow = max(1, np.median(spins) / 1.2)
    began = time.process_time()
    blocks = codec.encode_blocks(ids)
    assert np.array_equal(np.concatenate(codec.decode_blocks(blocks)), ids)
    assert time.process_time() - began < 2e-6 * len(ids) * slow
    share = np.bincount(ids)[1:] / len(ids)
    assert sum(map(len, blocks)) < 1.1 * len(ids) / 8 * -(share[share > 0] * np.log2(share[share > 0])).sum()


def test_codec_odd_streams():
    """Streams of all shapes, coded together and read in any order; a damaged header is found."""
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 2**31, 3000), np.tile(rng.integers(0, 60000, 700), 9), np.repeat(rng.integers(0, 9, 50), 99), np.zeros(64, np.int64), rng.integers(0, 300, 8193) ** 2, np.where(rng.random(9000) < 0.999, 5, rng.integers(0, 50000, 9000))):
        for block in (1, 31, 1000, 4096):
            part = ids[: 50 * block]
            blocks = codec.encode_blocks(part, block)
            order = rng.permutation(len(blocks)).tolist()
            for i, found in zip(order, codec.decode_blocks([blocks[i] for i in order])):
                assert np.array_equal(found, part[i * block : (i + 1) * block])
    for at in range(28):
        with pytest.raises(ValueError):
            codec.decode_blocks([blocks[0], blocks[-1][:at] + bytes([blocks[-1][at] ^ 64]) + blocks[-1][at + 1 :]])
    with pytest.raises(ValueError):
        codec.encode_blocks(ids, (1 << 18) + 1)


def test_token_files(spark, docs, odd):
    lib = tokenizer("word_bpe_49k.json")
    for table in (docs, odd, docs.limit(0)):
        path = token_files.new_path(spark)
        token_files.write_token_files(table, path, queries.vocabulary("word_bpe_49k.json"))
        got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        start = 0
        for r in got:
            assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
            start += r["n_tokens"]
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert keys == sorted(keys)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == sorted((-1 if r["doc_id"] is None else r["doc_id"], le(lib.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in table.collect())


def test_packing(spark, docs, odd):
    lib = tokenizer("byte_bpe_50k.json")
    for table in (docs, odd, docs.limit(0)):
        rows = packing.pack_documents(table, queries.vocabulary("byte_bpe_50k.json")).collect()
        want = sorted(le(lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in table.collect())
        assert sum(r["length"] for r in rows) == sum(len(w) // 4 for w in want)
        seen, windows = {}, {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert windows.get(r["sequence_id"], 0) == r["offset"] and len(r["ids"]) == 4 * r["length"]
            windows[r["sequence_id"]] = r["offset"] + r["length"]
        assert all(n <= 2048 and n & (n - 1) == 0 for n in windows.values())
        for r in sorted(rows, key=lambda r: r["start"]):
            seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        if table is docs:
            assert sorted(b"".join(p["ids"] for p in ps) for ps in seen.values()) == want


def test_packing_takes_best_neighbours():
    """Every window leads with its seed; each further document is the unused one of highest BM25 score, by the formula."""
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.6, rng.integers(1, 90)).clip(0, 200).astype("<u4") for _ in range(120)]
    docs += [docs[7].copy(), np.array([9999], "<u4"), np.arange(300, 700, dtype="<u4")]
    sets, n = [set(d.tolist()) for d in docs], len(docs)
    df = {t: sum(t in s for s in sets) for s in sets for t in s}
    mean = sum(map(len, docs)) / n

    def score(seed, d):
        norm = 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)
        tf = {t: int((docs[d] == t).sum()) for t in sets[seed] & sets[d]}
        return sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + norm) for t, f in tf.items())

    windows = packing.pack_shard(docs, 64)
    unused, seed, at = set(range(n)), None, {}
    for w in windows:
        for i, (d, start, length) in enumerate(w):
            assert start == at.get(d, 0)
            at[d] = start + length
            if start:
                assert i == 0
                seed = d
                continue
            scores = {e: score(seed, e) for e in unused} if i else {}
            if max(scores.values(), default=0) > 0:
                assert scores[d] >= max(scores.values()) - 1e-9
            else:
                assert d == min(unused)
                seed = d
            unused.remove(d)
    assert not unused and at == {d: len(x) for d, x in enumerate(docs)}
    assert all(sum(p[2] for p in w) == 64 for w in windows[:-1])


def test_exact_dedup(docs, odd):
    import re

    for table in (docs, odd, docs.limit(0)):
        rows = table.collect()
        norm = {}
        for r in rows:
            norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
        want = []
        for t, ids in norm.items():
            known = [i for i in ids if i is not None]
            keep = min(known) if known else None
            want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in exact_dedup.exact_groups(table).collect())
        assert exact_dedup.drop_exact_copies(table).count() == len(norm)


def brute_simhash(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("shard, top", [(8192, 12), (16, 12), (16, 2)])
def test_simhash(spark, docs, odd, shard, top, monkeypatch):
    """One shard, many, and many whose leaves grow trees of their own."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "TOP_LEVELS", top)
    monkeypatch.setattr(simhash, "SAMPLE_PER_SHARD", 8)
    near = docs.limit(40).select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"))
    for table in (docs.select("doc_id", "text").union(near), odd, docs.limit(0)):
        rows = table.collect()
        prints = [brute_simhash(r["text"]) for r in rows]
        group = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and group[i] != group[j]:
                    a, b = group[i], group[j]
                    group = [b if g == a else g for g in group]
        low = {}
        for g, r in zip(group, rows):
            if r["doc_id"] is not None:
                low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
        want = sorted(str((r["doc_id"], f"{p:016x}", low.get(g))) for r, p, g in zip(rows, prints, group))
        got = simhash.simhash_components(table).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_hamming_links_of_close_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << k) for k in range(0, 60, 3)], rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    heap = simhash.grow(fps, 3)
    leaf, rows, role = simhash.assign(fps, heap, 3)
    assert sorted(rows[role == 0]) == list(range(len(fps)))
    parent = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in set(leaf.tolist()):
        for u, v in simhash.shard_links(fps[rows[(leaf == k) & (role == 0)]], fps[rows[(leaf == k) & (role == 1)]], 3):
            parent[max(find(u), find(v))] = min(find(u), find(v))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    roots = [find(int(f)) for f in fps.view(np.int64)]
    assert len(set(roots)) == len(set(label.tolist())) == len(set(zip(roots, label.tolist())))


def test_imatch(spark, docs, odd):
    for table in (docs, odd.where("doc_id <> 3").union(odd.where("doc_id = 3").limit(1)), docs.limit(0)):
        rows = sorted(table.collect(), key=lambda r: -r["doc_id"])
        got = {r["doc_id"]: r for r in imatch.imatch(table).collect()}
        assert len(got) == len(rows)
        by_text = {}
        for k, r in enumerate(rows):
            t, after = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
            cut = len(t) // 3
            g = got[r["doc_id"]]
            assert g["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest() and g["n_chars"] == len(t)
            assert by_text.setdefault(t, g["fingerprint"]) == g["fingerprint"]
            assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        if table is docs:
            assert np.mean([r["near_edited"] for r in got.values()]) > 5 * np.mean([r["near_next"] for r in got.values()])


def test_imatch_of_hot_and_rare_texts(spark):
    """Copies don't move terms out of the band, and texts without terms of the band keep a graded likeness."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 120)) for _ in range(300)] + [" ".join(f"rare{k}x{i}" for i in range(90)) for k in range(5)]
    texts += [texts[0]] * 150
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = imatch.lexicon(table.where("doc_id < 305")).first()["terms"]
    assert imatch.lexicon(table).first()["terms"] == once
    got = {r["doc_id"]: r for r in imatch.imatch(table).collect()}
    assert got[0]["near_edited"] > 0 and all(got[i]["near_edited"] > 0 for i in range(301, 305))
    assert all(r["near_edited"] < 1 for i, r in got.items() if i < 305) and got[302]["near_next"] == 0


def test_imatch_lexicon_and_fingerprints(spark, docs):
    """Terms of the band and every text's fingerprint, against plain Python."""
    hashed = lambda raw, seed=42: xxhash.xxh64(raw, seed=seed).intdigest()
    of_long = lambda v, seed=42: hashed(int(v).to_bytes(8, "little"), seed)
    salted = lambda t, k: hashed(k.to_bytes(4, "little"), of_long(t))
    signed = lambda v: v - 2**64 if v >= 2**63 else v

    def terms(text):
        return {hashed(w.encode()) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = [terms(t) for t in set(texts.values())]
    df = {}
    for t in (t for o in own for t in o):
        df[t] = df.get(t, 0) + 1
    band = sorted((t for t, n in df.items() if max(2, imatch.LOW * len(own)) <= n <= imatch.HIGH * len(own)), key=signed)
    assert [t % 2**64 for t in imatch.lexicon(docs).first()["terms"]] == band

    def fingerprint(text):
        mine = terms(text)
        kept, out = [t for t in band if t in mine], ""
        if len(kept) < imatch.FEW:
            return "x" + "".join(f"{min((salted(t, k) for t in mine), key=signed):016X}"[8:] for k in range(len(imatch.SUBSETS)) if mine)
        for k, rate in enumerate(imatch.SUBSETS):
            chosen, h = [t for t in kept if signed(salted(t, k)) % rate == 0], 42
            for t in chosen:
                h = of_long(t, h)
            out += f"{h:016X}"[8:] if chosen else "--------"
        return out

    got = {r["doc_id"]: r["fingerprint"] for r in imatch.imatch(docs).collect()}
    assert got == {d: fingerprint(t) for d, t in texts.items()}


def test_chat_folds_events(spark):
    ev = [
        (1, 0, 0, "message", "user", "hi <|im_end|>"),
        (1, 1, 1, "message", "assistant", "He"),
        (1, 2, 1, "delta", None, "llo"),
        (1, 3, 1, "regenerate", None, "Good"),
        (1, 4, 1, "delta", None, " day\\n"),
        (1, 5, 0, "edit", None, "hey <|im_start|>\\"),
        (1, 6, 70, "message", "assistant", None),
        (1, 6, 70, "message", "assistant", "twice"),
        (None, None, None, None, None, None),
        (2, 0, 3, "delta", "assistant", "alone"),
    ]
    seg = chat.format_chats(spark.createDataFrame(ev, chat.EVENTS))
    assert all(r["formatted"].count("<|im_end|>") == r["formatted"].count("<|im_start|>") for r in seg.collect())
    got = {r["conv_id"]: r for r in chat.read_back(seg).collect()}
    assert got[1]["said"] == "user\nhey <|im_start|>\\\nassistant\nGood day\\n\nassistant\n\nassistant\ntwice\n"
    assert got[1]["loss"] == "Good day\\ntwice" and got[1]["n_turns"] == 4
    assert got[None]["said"] == "\n\n" and got[2]["loss"] == "alone"
    assert chat.format_chats(spark.createDataFrame([], chat.EVENTS)).count() == 0


def test_secrets(spark, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.scan(big.unionByName(odd.drop("ids"))).collect()
    real = r'(?i)token = "([0-9a-f]{40})"'
    want = {(r["doc_id"], r["s"]) for r in big.unionByName(odd.drop("ids")).select("doc_id", F.regexp_extract("text", real, 1).alias("s")).where("s <> ''").collect()}
    said = {(r["doc_id"], r["candidate"]) for r in found if r["is_secret"]}
    assert want <= said and len(said - want) <= 0.05 * len(said)
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.where(F.col("text").contains("04dbebab")).count() == 0
    assert secrets.scan(odd.limit(0)).count() == 0


def test_secrets_at_every_place(spark):
    """Each place has its own offset and verdict, and a string that is once a secret goes everywhere."""
    import re

    s, p = "04dbebab91ab85687d33eeaaf9ac699e1188f962", 'Tr0ub4dor&3'
    pem = "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    texts = [f'été 😀 commit {s} and then token = "{s}" end {s}', f'x{s}z {s} password: "{p}" or PWD = \'{p}\' {pem} {pem}', s, f"{s}\n{s}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = secrets.candidates(docs).collect()
    want = {(i, m.start(g), m[g]) for i, t in enumerate(texts) for q, g in ((secrets.PEM, 0), (secrets.RUN, 0), (secrets.GIVEN, 1)) for m in re.finditer(q, t)}
    assert len(rows) == len(want) and {(r["doc_id"], r["start"], r["candidate"]) for r in rows} == want
    for r in rows:
        t, a, b = texts[r["doc_id"]], r["start"], r["start"] + len(r["candidate"])
        assert (r["before"], r["after"]) == (t[max(0, a - secrets.BEFORE) : a], t[b : b + secrets.AFTER])
    said = {r["start"]: r["is_secret"] for r in secrets.scan(docs).where("doc_id = 0").collect()}
    assert not said[texts[0].index(s)] and any(said.values())
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs.union(docs.where("doc_id = 2").selectExpr("0L", "text", "lang", "source", "n_chars"))).collect() if r["n_chars"] != 40}
    assert clean[0] == texts[0].replace(s, secrets.MARK) and f"x{s}z" in clean[1]  # not inside a longer run
    assert secrets.redact(docs).where("doc_id = 0").where(F.col("text").contains(s)).count() == 0


def test_secrets_of_a_log(spark):
    """One text of very many candidates, more than fit a block: places, surroundings and redaction hold, against plain Python."""
    import hashlib
    import re

    lines = [f'{"token" if i % 3 else "commit"} = "{hashlib.sha1(str(i % 700).encode()).hexdigest()}" é{i}' for i in range(1800)]
    text = "\n".join(lines) + "=" * 20
    docs = spark.createDataFrame([(5, text, "en", "s", len(text))] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    rows = {(r["start"], r["candidate"]): r for r in secrets.candidates(docs.limit(1)).collect()}
    assert set(rows) == {(m.start(g), m[g]) for q, g in ((secrets.RUN, 0), (secrets.GIVEN, 1)) for m in re.finditer(q, text)}
    for (a, c), r in rows.items():
        assert (r["before"], r["after"]) == (text[max(0, a - secrets.BEFORE) : a], text[a + len(c) : a + len(c) + secrets.AFTER])
    bad = {r["candidate"] for r in secrets.scan(docs).where("is_secret").collect()}
    assert len(bad) >= 400
    want = text
    for c in bad:
        want = want.replace(c, secrets.MARK)
    assert [(r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()] == [(want, len(want))] * 2


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    judged = quality.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    right = np.mean([(r["p_quality"] >= 0.5) == (r["quality"] == 1) for r in judged])
    clean = [r["keep"] for r in judged if r["quality"] == 1 and r["toxic"] == 0]
    assert right > 0.9 and np.mean(clean) > 0.95


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, none).count() == odd.count()
    assert quality.keep_good(odd.limit(0), none).columns == odd.columns
    named = odd.withColumns({"keep": F.lit("mine"), "p_quality": F.lit(7), "a.b": F.lit("dot")})
    kept = quality.keep_good(named, none)
    assert kept.columns == named.columns and kept.count() in (0, odd.count())
    assert {tuple(r) for r in kept.select("keep", "p_quality", "`a.b`").collect()} <= {("mine", 7, "dot")}
    judged = quality.classify(named, none)
    assert dict(judged.dtypes)["keep"] == "boolean" and dict(judged.dtypes)["p_quality"] == "double"


def test_exchange_by_hand(spark, odd):
    """Pseudo-labelled counts of every row against a plain loop, and none for rows of the sample."""
    zero, one = (quality.Linear(n, w=np.zeros(n)) for n in (quality.TEXT, quality.META))
    rows = [(i, quality.text_features(t or ""), quality.meta_features("s", "en", len(t or ""))) for i, t in enumerate(ODD)]
    zero.w[rows[9][1][:1]] = 40.0
    zero.b = -20.0
    model = quality.CoTrained({"text": zero, "meta": one}, {"text": np.array([1.0, 0.0]), "meta": np.array([1.0, 0.0])}, np.zeros(3))
    got = quality.exchange(quality._featured(odd.where("doc_id is not null and source is not null")), {"q": model}, {3})["q"]
    want = np.zeros((2, quality.META))
    for i, text, meta in rows:
        p = 1 / (1 + np.exp(-np.clip((zero.w[text].sum() + zero.b) / 4, -8, 8)))
        if i != 3 and (p >= quality.SURE or p <= 1 - quality.SURE):
            np.add.at(want[int(p >= quality.SURE)], meta, 1)
    assert want[0].sum() and want[1].sum()
    assert np.array_equal(got["meta"], want) and not got["text"].any()


def test_quality_counts_of_both_classes():
    """The weights follow labelled and pseudo-labelled counts; a hand-made round."""
    x = quality.Rows.of([np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])] * 10)
    y = np.array([1, 1, 0, 0] * 10)
    more = np.zeros((2, 4))
    m = quality.Linear(4).fit(x, y, more)
    assert m.w[0] > 0 > m.w[1] and abs(m.w[2]) < 1e-9 and m.w[3] == 0
    more[1, 3] = 50
    assert quality.Linear(4).fit(x, y, more).w[3] > 0


def test_language(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.createDataFrame([(1, "http://a.example.fr/", '<html lang="fr"><p>' + "le la de que " * 30), (2, None, None), (2, None, None), (3, "nonsense", "")], "page_id long, url string, html string")
    rows = langid.identify(pages, docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([truth[r["doc_id"]] == r["lang"] for r in rows if r["doc_id"] is not None]) > 0.98
    by = {r["page_id"]: r for r in rows if r["page_id"] is not None}
    assert by[1]["lang"] == "fr" and len([r for r in rows if r["page_id"] == 2]) == 2
    assert langid.identify(pages.limit(0), odd.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(after, docs.schema)
        if name == "exact dedup":
            assert len(after) == len({" ".join((r["text"] or "").split()) for r in before})
        if name == "simhash near-dedup":
            from tests.llm.test_resemblance import survivors

            assert {r["doc_id"] for r in after} == survivors(sorted((r["doc_id"], r["text"]) for r in before))
        if name == "secret scans":
            assert len(after) == len(before) and not any('token = "' in r["text"] and "[SECRET]" not in r["text"] for r in after)
        if name == "packing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            assert sum(r["length"] for r in after) == sum({r["doc_id"]: r["doc_tokens"] for r in after}.values())
    assert zlib.crc32(b"") == 0
