"""Quality and toxicity by co-training of a text-content and a page-metadata view.

Both classifiers are logistic regressions over log-count ratios. The text view
sees hashed words and the layout of the content; the metadata view sees only
what is said about the page: its source, its declared language and length.

Each round passes over all documents that aren't in the labelled sample: where
a view's calibrated probability is at least ``SURE``, the row counts, under that
pseudo-label, towards the other view's class counts. The counts of all rows are
summed by a grouped aggregation (a bounded number of buckets), and both views
are fitted anew with them. At last the calibrated views are combined by a small
regression, and score every document.

Only the labelled rows that fit the weights are a bounded sample: at most
``labelled`` rows, the first in the order of a hash of doc_id, and at most
``SAMPLE_BYTES`` of features. Pseudo-labels and scoring cover all documents and
whole texts.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from policyspark.llm.bpe import slices
from policyspark.llm.common import bound_batches, discard, give_back, lean, materialize

WORDS, META = 1 << 16, 1 << 11
#: Buckets of the text view: words, then layout.
TEXT = WORDS + 256
#: Calibrated probability from which a view's answer counts as a pseudo-label, and its weight.
SURE, PSEUDO = 0.95, 0.5
SAMPLE_BYTES = 128 << 20
#: How many words a layout number weighs as much as.
LAYOUT = 6
#: Bytes that stand for markup or noise rather than prose.
_SIGNS = b"|%$&#*!<>{}[]=_~^\\"
_hash: dict[str, int] = {}


def word_buckets(text: str) -> np.ndarray:
    """Buckets of the distinct lower-cased words, without surrounding signs."""
    if len(_hash) > 400_000:
        _hash.clear()
    out = set()
    for w in set(text.lower().split()):
        b = _hash.get(w)
        if b is None:
            b = _hash[w] = zlib.crc32(w.strip(".,;:!?%$&#*|\"'()").encode()) % WORDS
        out.add(b)
    return np.fromiter(out, np.int64, len(out))


def layout(text: str) -> list[float]:
    """Numbers about a text's layout; none of them depends on its vocabulary."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    words = text.split()
    lines = text.split("\n")
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    signs = int(count[list(_SIGNS)].sum())
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(raw) / len(lines)),
        count[65:91].sum() / letters,
        count[48:58].sum() / n,
        min(1.0, 8 * signs / n),
        count[[44, 46, 63]].sum() / max(1, len(words)),
        len(set(words)) / max(1, len(words)),
        repeats / max(1, len(words)),
        len(set(lines)) / len(lines),
    ]


def text_features(text: str) -> np.ndarray:
    """Buckets of the text view: distinct words and binned layout numbers."""
    bins = [WORDS + k * 16 + min(15, int((x if k < 3 else 16 * x) + 0.5)) for k, x in enumerate(layout(text))]
    return np.append(word_buckets(text), np.tile(np.array(bins, np.int64), LAYOUT)).astype(np.int32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Buckets of the metadata view: source, language, stated length and pairs of them, by hash."""
    size = "none" if n_chars is None else str(min(40, int(2 * math.log2(max(1, n_chars)))))
    said = [f"s:{source}", f"l:{lang}", f"n:{size}", f"sl:{source}|{lang}", f"ln:{lang}|{size}"]
    return np.array([zlib.crc32(x.encode()) % META for x in said], np.int32)


@dataclass
class Rows:
    """A sparse matrix by rows; all values are one."""

    idx: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> "Rows":
        return cls(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum([0, *map(len, rows)]))

    def pick(self, which: np.ndarray) -> "Rows":
        return Rows.of([self.idx[self.starts[i] : self.starts[i + 1]] for i in which])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0.0, np.cumsum(w[self.idx]))[self.starts])

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.idx, np.repeat(r, np.diff(self.starts)), size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic regression over log-count ratios, trained by full-batch Adagrad."""

    size: int
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: float = 0.0

    def fit(self, x: Rows, y: np.ndarray, more: np.ndarray, steps: int = 60, penalty: float = 1e-3) -> "Linear":
        """Fits labelled rows; ``more`` holds pseudo-labelled rows' counts of each bucket, for class 0 and 1."""
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        wt = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
        neg, pos = x.back(1.0 - y, self.size), x.back(y.astype(float), self.size)
        seen = neg + pos + more.sum(axis=0)
        # counts as if the classes had equally many words
        neg, pos = neg + PSEUDO * more[0], pos + PSEUDO * more[1]
        level = max(1.0, pos.sum()) / max(1.0, neg.sum())
        ratio = np.log((pos + 1) / (neg * level + 1)) * (seen >= 3)
        self.w, self.b = ratio * 0.2, 0.0
        memory, total = np.full(self.size, 1e-8), wt.sum()
        for _ in range(steps):
            r = wt * (_sigmoid(x.times(self.w) + self.b) - y)
            g = x.back(r, self.size) / total * np.abs(ratio) + penalty * self.w
            memory += g * g
            self.w -= 0.2 * g / np.sqrt(memory) * (ratio != 0)
            self.b -= 0.5 * r.sum() / total
        return self

    def odds(self, x: Rows) -> np.ndarray:
        return x.times(self.w) + self.b


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of the columns of ``z`` and a constant that fit ``y`` as log-odds."""
    x = np.column_stack([np.clip(z / 4, -8, 8), np.ones(len(z))])
    w, memory = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        g = x.T @ (_sigmoid(x @ w) - y) / max(1, len(y)) + 1e-3 * w
        memory += g * g
        w -= 0.3 * g / np.sqrt(memory)
    w[: z.shape[1]] = np.maximum(w[: z.shape[1]], 0)  # a view may count for nothing, but not against itself
    return w


VIEWS = {"text": TEXT, "meta": META}


@dataclass
class CoTrained:
    """Both views with their own calibrations (slope, constant), and the weights that combine them."""

    views: dict[str, Linear]
    own: dict[str, np.ndarray]
    mix: np.ndarray

    def sure(self, name: str, x: Rows) -> np.ndarray:
        """1 or 0 where this view alone is sure, else -1."""
        p = _sigmoid(np.clip(self.views[name].odds(x) / 4, -8, 8) * self.own[name][0] + self.own[name][1])
        return np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))

    def probability(self, xt: Rows, xm: Rows) -> np.ndarray:
        z = np.column_stack([self.views["text"].odds(xt), self.views["meta"].odds(xm)])
        return _sigmoid(np.clip(z / 4, -8, 8) @ self.mix[:-1] + self.mix[-1])


def fit_views(x: dict[str, Rows], y: np.ndarray, more: dict[str, np.ndarray]) -> CoTrained:
    """One round: every fourth labelled row only calibrates. ``more``: pseudo-labelled counts of each view."""
    rows = np.flatnonzero(y >= 0)
    hold, train = rows[::4], rows[np.arange(len(rows)) % 4 != 0]
    if len(set(y[train].tolist())) < 2 or len(set(y[hold].tolist())) < 2:  # nothing can be learnt: the labels' share for all
        prior = float(y[rows].mean()) if len(rows) else 0.5
        odds = math.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
        blank = {v: Linear(size, w=np.zeros(size)) for v, size in VIEWS.items()}
        return CoTrained(blank, {v: np.zeros(2) for v in VIEWS}, np.array([0.0, 0.0, odds]))
    fitted = {v: Linear(size).fit(x[v].pick(train), y[train], more[v]) for v, size in VIEWS.items()}
    z = np.column_stack([fitted[v].odds(x[v].pick(hold)) for v in VIEWS])
    truth = y[hold].astype(float)
    return CoTrained(fitted, {v: _platt(z[:, [k]], truth) for k, v in enumerate(VIEWS)}, _platt(z, truth))


def _buckets(column: pa.Array) -> Rows:
    """Rows of a binary column of little-endian 32-bit buckets."""
    return Rows.of([np.frombuffer(b, "<i4").astype(np.int64) for b in column.to_pylist()])


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id and both views' buckets (binary, little-endian 32-bit) of every row."""

    def stage(batches):
        for batch in batches:
            ids, sources, langs, sizes = batch.column(0), *(batch.column(i).to_pylist() for i in (2, 3, 4))
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                text = [text_features(t or "").tobytes() for t in texts[a:b]]
                meta = [meta_features(*m).tobytes() for m in zip(sources[a:b], langs[a:b], sizes[a:b])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "text", "meta"])

    return docs.select(*_inputs(docs)).mapInArrow(lean(stage), "doc_id long, text binary, meta binary")


def _inputs(docs: DataFrame) -> list:
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size.alias("n_chars")]


def exchange(feats: DataFrame, models: dict[str, CoTrained], sample: set[int]) -> dict[str, dict[str, np.ndarray]]:
    """For each target and view, counts of buckets by class, over all rows that the other view is sure of.

    Rows of the labelled sample don't count. What comes back is one number for
    each target, view, class and bucket.
    """
    shared = feats.sparkSession.sparkContext.broadcast((models, sample))  # a fixed number of weights and ids

    def stage(batches):
        fitted, known = shared.value
        sums = {(t, v): np.zeros((2, size), np.int64) for t in fitted for v, size in VIEWS.items()}
        for batch in batches:
            free = np.array([i not in known for i in batch.column(0).to_pylist()], bool)
            x = {v: _buckets(batch.column(1 + k)) for k, v in enumerate(VIEWS)}
            for t, m in fitted.items():
                for v, other in (("text", "meta"), ("meta", "text")):
                    said = m.sure(other, x[other])
                    for c in (0, 1):
                        sums[t, v][c] += x[v].back(((said == c) & free).astype(float), VIEWS[v]).astype(np.int64)
        for (t, v), n in sums.items():
            c, at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.string()), pa.array([v] * len(at), pa.string()), pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[c, at])], ["target", "view", "class", "bucket", "n"])

    rows = feats.mapInArrow(lean(stage), "target string, view string, class int, bucket int, n long").groupBy("target", "view", "class", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = {t: {v: np.zeros((2, size)) for v, size in VIEWS.items()} for t in models}
    target, view = (np.array(rows.column(c).to_pylist(), object) for c in ("target", "view"))
    number, bucket, n = (rows.column(c).to_numpy() for c in ("class", "bucket", "n"))
    for t in out:
        for v in VIEWS:
            mine = (target == t) & (view == v)
            out[t][v][number[mine], bucket[mine]] = n[mine]
    return out


def labelled_sample(feats: DataFrame, labels: DataFrame, targets: tuple[str, ...], labelled: int) -> tuple[dict[str, Rows], dict[str, np.ndarray], set[int]]:
    """Both views' buckets, the labels (-1: none) and the doc_ids of the sample.

    Of several labels of one document the largest counts, and of several texts
    the first; null labels and labels of unknown documents count for nothing.
    """
    marks = labels.where(F.coalesce(*targets).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(t).cast("int")).alias(t) for t in targets])
    chosen = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labels")  # bounded, so it may be broadcast
    found = feats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *targets).agg(F.min(F.struct("text", "meta")).alias("x"))
    found = materialize(found.select("doc_id", *targets, "x.*"), "sample")
    sizes = found.select("doc_id", F.octet_length("text")).collect()
    sizes.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    ends = np.cumsum([r[1] for r in sizes])
    place = {r[0]: k for k, r in enumerate(sizes[: int(np.searchsorted(ends, SAMPLE_BYTES, side="right"))])}
    table = found.where(F.col("doc_id").isin(list(place))).toArrow() if len(place) < len(sizes) else found.toArrow()
    order = np.argsort([place[i] for i in table.column("doc_id").to_pylist()]).tolist()
    x = {v: _buckets(table.column(v).combine_chunks() if table.num_rows else pa.array([], pa.binary())).pick(np.array(order, np.int64)) for v in VIEWS}
    y = {t: np.array([-1 if (k := table.column(t)[i].as_py()) is None else k for i in order], np.int64) for t in targets}
    discard(chosen, found)
    return x, y, set(place)


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), labelled: int = 6000, rounds: int = 2) -> dict[str, CoTrained]:
    """A model for each label column, by at most ``rounds`` exchanges of pseudo-labels over all documents.

    They end when an exchange brings the counts of the one before.
    """
    bound_batches(docs.sparkSession)
    feats = materialize(_featured(docs), "features")
    x, y, sample = labelled_sample(feats, labels, targets, labelled)
    more = {t: {v: np.zeros((2, size)) for v, size in VIEWS.items()} for t in targets}
    models = {t: fit_views(x, y[t], more[t]) for t in targets}
    for _ in range(rounds):
        before, more = more, exchange(feats, models, sample)
        if all(np.array_equal(before[t][v], more[t][v]) for t in targets for v in VIEWS):
            break
        models = {t: fit_views(x, y[t], more[t]) for t in targets}
    discard(feats)
    x.clear()
    give_back()  # the sample was the driver's; other stages follow in its process
    return models


def _scored(docs: DataFrame, models: dict[str, CoTrained], names: list[str]) -> DataFrame:
    """``docs`` with a probability column, of the given name, for each model."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(models)  # a fixed number of weights
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)], *[c.alias(f"x{i}") for i, c in enumerate(_inputs(docs)[1:])])

    def stage(batches):
        fitted = shared.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts, *said = (batch.column(at[f"x{i}"]).to_pylist() for i in range(4))
            for a, b in slices(texts):
                xt = Rows.of([text_features(t or "") for t in texts[a:b]])
                xm = Rows.of([meta_features(*m) for m in zip(*(c[a:b] for c in said))])
                scores = [pa.array(m.probability(xt, xm)) for m in fitted.values()]
                yield pa.RecordBatch.from_arrays([*(batch.column(at[o]).slice(a, b - a) for o in own), *scores], [*own, *(f"s{i}" for i in range(len(scores)))])

    schema = StructType([*rows.select(*own).schema.fields])
    for i in range(len(models)):
        schema = schema.add(f"s{i}", DoubleType())
    return rows.mapInArrow(lean(stage), schema).toDF(*docs.columns, *names)


def score(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """``docs`` with a probability column ``p_<target>`` for each model.

    All rows stay, repeated ones too. Null and empty texts are scored by their
    metadata and the layout of an empty text. A column of ``docs`` that is
    already called p_<target> is replaced; others stay. An empty table gives an
    empty result.
    """
    names = [f"p_{t}" for t in models]
    return _scored(docs.drop(*[c for c in docs.columns if c in names]), models, names)


def classify(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.3, **bounds: int) -> DataFrame:
    """``docs`` with p_quality, p_toxic and ``keep``, which replace columns of these names; see :func:`score`."""
    scored = score(docs, fit(docs, labels, **bounds))
    return scored.withColumn("keep", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic))


def keep_good(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.3, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with their own columns as they were, whatever their names.

    Rows with null or empty texts are judged like any other; repeated rows are
    judged alike; without labels of both classes every row has the labels'
    share (0.5 if there are none), and an empty table stays empty.
    """
    models = fit(docs, labels, **bounds)
    names = [f"_p{i}_{uuid.uuid4().hex[:8]}" for i in range(len(models))]
    p = dict(zip(models, names))
    return _scored(docs, models, names).where((F.col(p["quality"]) >= least_quality) & (F.col(p["toxic"]) < most_toxic)).select(*[f"`{c}`" for c in docs.columns])
