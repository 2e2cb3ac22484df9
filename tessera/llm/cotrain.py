"""Quality classifier by co-training.

Two classifiers see a document from two sides: its text (hashed word counts and shares of byte classes) and its
metadata (language, source, length). Both start from labelled documents. In each round both views score every unlabelled
document; either labels the share of them that it is most certain of, and the other learns from these too. Each is
then calibrated on labelled documents that it hasn't learned from, and the calibrated views are combined to score every
document, whole texts.

A fit takes bounded samples of labelled rows: LABELLED of either class (toxic ones count as bad) of the given labels, and
PSEUDO of either class of a round's pseudo-labels, chosen by a hash. Scoring, and the thresholds of what is certain,
cover all documents. A document is good if its quality is 1 and it isn't toxic.

Defined results: a null text is scored as the empty one and null metadata as values of their own; documents with
several labels take the lowest of each, and of rows with one id the one with the smallest text hash is learned from;
labels of unknown documents and null labels take no part; if too few sampled labels are bad, or good, scores are the
smoothed share of good ones; repeated rows are scored each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Labelled documents to learn from, and pseudo-labelled ones that a view learns from in a round: at most about so many of either class.
LABELLED, PSEUDO = 2500, 600
#: Hashed words; values of the metadata view.
WORD_BINS, META_BINS = 2048, 128
#: Rounds of exchange, and the share of the unlabelled documents that a view labels for the other in each, by class.
ROUNDS, SHARE = 3, 0.05
#: From which score a document is kept.
KEEP = 0.4

_hash = xxhash.xxh3_64_intdigest
#: Bytes by class: upper case, lower case, digit, space, line feed, other ASCII signs each by itself, beyond ASCII.
_CLASSES = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c == 32 else 4 if c == 10 else 5 if c >= 128 else 6 + c % 34 for c in range(256)])
_SIGNS = 40


def text_view(text: str | None) -> np.ndarray:
    """Hashed word counts, damped, scaled to length one; shares of byte classes; length."""
    data = (text or "").encode()
    out = np.zeros(WORD_BINS + _SIGNS + 2, np.float32)
    words = data.lower().split()
    if words:
        bins = np.fromiter(map(_hash, words), np.uint64, len(words)) & np.uint64(WORD_BINS - 1)
        counts = np.log1p(np.bincount(bins.astype(np.int64), minlength=WORD_BINS))
        out[:WORD_BINS] = 8 * counts / np.sqrt((counts**2).sum())
        signs = np.bincount(_CLASSES, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=_SIGNS)
        out[WORD_BINS:-2] = np.sqrt(signs[:_SIGNS] / len(data)) * 4
        out[-2] = len(set(words)) / len(words)
    out[-1] = np.log1p(len(words)) / 8
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_BINS, np.float32)
    for k, value in ((0, f"lang {lang}"), (32, f"source {source}")):
        out[k + _hash(value) % (32 if k == 0 else 64)] += 1
    size = np.log2(1 + max(0, n_chars or 0))
    out[96 + min(30, int(size))] = 1
    out[-1] = size / 16
    return out


class Logistic:
    """Logistic regression by full-batch gradient steps with momentum; weights by class, so that rare ones count."""

    def __init__(self, width: int) -> None:
        self.w, self.b = np.zeros(width, np.float32), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> Logistic:
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32) / len(y)
        w, b, vw, vb = np.zeros_like(self.w), 0.0, np.zeros_like(self.w), 0.0
        for _ in range(steps):
            error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
            vw = 0.9 * vw - rate * (x.T @ error + decay * w)
            vb = 0.9 * vb - rate * float(error.sum())
            w, b = w + vw, b + vb
        self.w, self.b = w.astype(np.float32), b
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


WIDTH = WORD_BINS + _SIGNS + 2


class CoTrained:
    """Both views with their calibration; `share` is that of good ones among all labels."""

    def __init__(self, views: np.ndarray, y: np.ndarray, share: float) -> None:
        self.views, self.y, self.prior = views, y, share
        self.usable = min((y > 0).sum(), (y == 0).sum()) >= 5
        held = np.arange(len(y)) % 5 == 0
        self.held = held if len(set(y[held].tolist())) == 2 else np.zeros(len(y), bool)
        if self.usable:
            self.fit({})

    def fit(self, extra: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit each view to the labels it may learn from and to those that the other gave; then calibrate."""
        self.models = {}
        for name, of in (("text", slice(0, WIDTH)), ("meta", slice(WIDTH, None))):
            more, given = extra.get(name, (np.zeros((0, self.views.shape[1]), np.float32), np.zeros(0, np.float32)))
            x = np.concatenate([self.views[~self.held, of], more[:, of]])
            self.models[name] = Logistic(x.shape[1]).fit(x, np.concatenate([self.y[~self.held], given]).astype(np.float32))
        on = self.held if self.held.any() else ~self.held
        margins = np.stack(self.margins(self.views[on, :WIDTH], self.views[on, WIDTH:]), axis=1)
        self.mix = self._calibrated(margins.astype(np.float32), self.y[on], self.prior)

    def margins(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip(self.models[n].margin(x), -12, 12) / 4 for n, x in (("text", text), ("meta", meta)))

    def without_rows(self) -> CoTrained:
        """What scoring needs."""
        other = object.__new__(CoTrained)
        other.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("views", "y", "held")}
        return other

    @staticmethod
    def _calibrated(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
        """Weights of both margins and a constant that give probabilities, classes as frequent as among all labels; no weight is negative."""
        w, b = np.array([1.0, 0.0]), 0.0
        each = np.where(y > 0, share / max((y > 0).mean(), 1e-6), (1 - share) / max((y == 0).mean(), 1e-6)) / len(y)
        for _ in range(600):
            error = (1 / (1 + np.exp(-(x @ w + b))) - y) * each
            w = np.maximum(0, w - 1.0 * (x.T @ error + 1e-3 * w))
            b -= 1.0 * float(error.sum())
        return float(w[0]), float(w[1]), b

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, and the text's and the metadata's alone."""
        if not self.usable:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        t, m = self.margins(text, meta)
        a, b, c = self.mix
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        return sigmoid(a * t + b * m + c), sigmoid(a * t + c), sigmoid(b * m + c)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """From columns text, lang, source, n_chars."""
    rows = list(zip(*(batch.column(n) for n in ("text", "lang", "source", "n_chars")), strict=True))
    text = np.stack([text_view(r[0].as_py()) for r in rows])
    return text, np.stack([meta_view(r[1].as_py(), r[2].as_py(), r[3].as_py()) for r in rows])


_DOC = ["text", "lang", "source", "n_chars"]


def _key() -> Column:
    """A hash of what a document is scored by."""
    return F.xxhash64("doc_id", *_DOC)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            text, meta = _views(batch)
            packed = [np.concatenate([t, m]).astype(np.float16).tobytes() for t, m in zip(text, meta, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["key", "label", "views"])


def _few(keys: DataFrame, most: int) -> DataFrame:
    """About `most` rows of (key, label) for each label, those with the smallest hashes; the labels are few."""
    counts = {r.label: r["count"] for r in keys.groupBy("label").count().collect()}
    size, hashed = 1 << 30, F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30))
    chosen = F.lit(False)
    for label, n in counts.items():
        chosen = chosen | ((F.col("label") == label) & (hashed < int(min(1.0, most / n) * size)))
    return keys.where(chosen)


def _collected(docs: DataFrame, few: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of the documents with these keys, copies once, in the order of the keys."""
    rows = docs.withColumn("key", _key()).join(F.broadcast(few), "key").dropDuplicates(["key", "label"]).select("key", "label", *_DOC)
    rows = sorted(rows.mapInArrow(_pack, "key long, label int, views binary").collect(), key=lambda r: (r.key, r.label))
    x = np.stack([np.frombuffer(r.views, np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH + META_BINS), np.float32)
    return x, np.array([r.label for r in rows], np.float32)


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Learn both views from the documents (doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic)."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", good.alias("label"))
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", _key().alias("key"))
    marked = written(ids.groupBy("doc_id").agg(F.min("key").alias("key")).join(known, "doc_id").select("key", "label"))
    counts = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    model = CoTrained(*_collected(docs, _few(marked, LABELLED)), (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    if not model.usable:
        return model
    named = docs.where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.without_rows())

        def margins(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = [pa.array(m.astype(np.float64)) for m in shared.value.margins(*_views(part))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], ["doc_id", "key", "text", "meta"])

        seen = named.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), *_DOC).mapInArrow(margins, "doc_id long, key long, text double, meta double")
        # Only ids, hashes and margins are dealt out to leave the labelled ones away.
        seen = written(seen.join(known.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").select("key", "text", "meta").distinct())
        share = SHARE * (round_ + 1)
        ends = [share * (1 - model.prior), 1 - share * model.prior]
        limits = seen.agg(*[F.percentile_approx(v, ends, 1000).alias(v) for v in ("text", "meta")]).first()
        extra = {}
        for view, other in (("text", "meta"), ("meta", "text")):
            if limits[view] is None:
                continue
            # Certain ones only: a view that can't tell (its margins are small) labels nothing for the other.
            low, high = min(limits[view][0], -0.5), max(limits[view][1], 0.5)
            label = F.when(F.col(view) <= low, 0).when(F.col(view) >= high, 1)
            few = _few(seen.select("key", label.alias("label")).where(F.col("label").isNotNull()), PSEUDO)
            extra[other] = _collected(named, few)
        model.fit(extra)
        shared.destroy()
    return model


def scored(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, text_score, meta_score, keep) for every document."""
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels).without_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both, text, meta = model.score(*_views(part))
                fields = [pa.array(np.round(v.astype(np.float64), 6)) for v in (both, text, meta)]
                yield pa.RecordBatch.from_arrays([part.column(0), *fields, pa.array(both >= keep)], ["doc_id", "score", "text_score", "meta_score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double, keep boolean")
