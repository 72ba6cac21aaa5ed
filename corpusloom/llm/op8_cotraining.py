"""Quality and toxicity scores by co-training of two views.

One classifier sees a document's text (hashed words and shape), another its
metadata (source, language, length). Both start from a bounded sample of
labelled rows. In each round both score all documents without a label; the ones
that a view is most sure of are what the other learns from next, and the words
of the text view are chosen anew. On labelled rows that were kept apart each
view is calibrated, and the calibrated views together score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BYTE_VALUES, buffers, by_arrow, parts_of_rows, powers, stored

#: Labelled rows that the classifiers are fitted on, about.
LABELLED = 12_000
#: Buckets of hashed words, and of metadata.
BUCKETS, META = 1 << 20, 1 << 11
#: How far a word's share of a class must be off for the text view to know it, in standard errors.
STRIKING = 5.0
#: Rounds, pseudo-labels of a class that a view gives in one, their least probability, and parts in which the surest are looked for.
ROUNDS, GIVEN, SURE, PARTS = 3, 400, 0.97, 64
#: Bytes of distinct words (four each) beyond which a row teaches nothing, and of those of all labelled rows at most.
TAUGHT_BYTES, LABELLED_BYTES = 1 << 14, 64_000_000
#: Every so many'th labelled row is kept apart to calibrate.
APART = 5
TARGETS = ("quality", "toxic")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_UP = np.zeros(256, bool)
_UP[0x41:0x5B] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
#: Numbers of a text's shape, and bins of each.
SHAPE, BINS = 7, 64


def text_sums(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows: (row, word bucket) as one number, distinct and in order; and by row the numbers of words, letters, capitals, marks and bytes."""
    rows = len(at) - 1
    low = _FOLD[data]
    word = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at[:-1]] = True
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])) | word & edge[:-1])
    ends = np.flatnonzero(word & ~np.concatenate((word[1:], [False])) | word & edge[1:]) + 1
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[low] * powers(len(data)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(len(data) + 1, "down")[starts]
    h ^= h >> np.uint64(29)
    bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64) % BUCKETS
    doc = np.searchsorted(at, starts, "right") - 1
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[at])
    numbers = np.stack([np.bincount(doc, minlength=rows), sums(word), sums(_UP[data]), sums(~word & ~_GAP[data]), np.diff(at)], axis=1)
    return np.unique(doc * BUCKETS + bucket), numbers


def _shaped(pairs: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct = np.bincount(pairs // BUCKETS, minlength=len(numbers))
    n, letters, capitals, marks, size = numbers.T
    words, size = np.maximum(1, n), np.maximum(1, size)
    shape = np.stack([
        np.log1p(n) / 10, distinct / np.maximum(1, np.sqrt(n) * 10), distinct / words, capitals / size,
        letters / size, marks / size, letters / words / 10,
    ], axis=1)
    return pairs % BUCKETS, distinct, shape


def text_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: distinct word buckets (flat, with counts by row), and SHAPE numbers between 0 and about 1."""
    return _shaped(*text_sums(data, at))


def meta_buckets(source: str | None, lang: str | None, size: int | None) -> list[int]:
    """Buckets of a row's metadata."""
    of = lambda x: zlib.crc32(x.encode()) % META
    return [of(f"s:{source}"), of(f"l:{lang}"), of(f"n:{(size or 0).bit_length()}")]


class Linear:
    """Logistic regression over sparse 0/1 features and a few dense ones."""

    def __init__(self, buckets: int, dense: int):
        self.w, self.d, self.b = np.zeros(buckets), np.zeros(dense), 0.0

    def logits(self, flat: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(counts)), counts)
        return np.bincount(row, self.w[flat], minlength=len(counts)) + dense @ self.d + self.b

    def fit(self, flat: np.ndarray, counts: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Linear:
        """Adagrad over all rows, each with its weight."""
        row = np.repeat(np.arange(len(counts)), counts)
        g2w, g2d, g2b = np.full(len(self.w), 1e-8), np.full(len(self.d), 1e-8), 1e-8
        total = weight.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(self.logits(flat, counts, dense), -30, 30)))
            e = (p - y) * weight / total
            gw = np.bincount(flat, e[row], minlength=len(self.w)) + decay * self.w
            gd, gb = e @ dense + decay * self.d, e.sum()
            g2w += gw * gw
            g2d += gd * gd
            g2b += gb * gb
            self.w -= rate * gw / np.sqrt(g2w)
            self.d -= rate * gd / np.sqrt(g2d)
            self.b -= rate * gb / np.sqrt(g2b)
        return self


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a >= 0 and b of sigmoid(a z + b) for rows kept apart, by Newton steps on smoothed targets."""
    pos = y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 0.0, float(np.log((t.mean()) / (1 - t.mean())))
    scale = max(1e-9, float(np.abs(z).max()))
    z = z / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 3 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    if a < 0:  # the view is no better than chance
        a, b = 0.0, float(np.log(t.mean() / (1 - t.mean())))
    return a / scale, b


def striking(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets of words whose presence goes with a class, in order."""
    ones = np.bincount(np.concatenate([np.zeros(0, np.uint32), *(w for w, t in zip(words, y) if t > 0)]).astype(np.int64), minlength=BUCKETS)
    none = np.bincount(np.concatenate([np.zeros(0, np.uint32), *(w for w, t in zip(words, y) if t <= 0)]).astype(np.int64), minlength=BUCKETS)
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    n = ones + none
    off = ones * (n0 / (n0 + n1)) - none * (n1 / (n0 + n1))  # above what is to be expected
    z = np.abs(off) * np.sqrt((n0 + n1) ** 3 / np.maximum(1.0, n * (n0 + n1 - n) * float(n0) * n1))
    return np.flatnonzero(z >= STRIKING)


class Known:
    """Features of the text view by number: words that are known, and bins of the shape."""

    def __init__(self, buckets: np.ndarray):
        self.words = len(buckets)
        self.size = self.words + SHAPE * BINS
        self.table = np.full(BUCKETS, -1, np.int32)
        self.table[buckets] = np.arange(len(buckets))

    def of(self, flat: np.ndarray, counts: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of rows with these words and shapes, how many each has, and the shapes."""
        at = self.table[flat]
        row = np.repeat(np.arange(len(counts)), counts)
        on = at >= 0
        bins = np.clip((shape * BINS).astype(np.int64), 0, BINS - 1) + self.words + np.arange(SHAPE) * BINS
        row = np.concatenate((row[on], np.repeat(np.arange(len(counts)), SHAPE)))
        order = np.argsort(row, kind="stable")
        return np.concatenate((at[on], bins.ravel()))[order], np.bincount(row, minlength=len(counts)), shape


class Rows:
    """Features of sampled rows, both views."""

    def __init__(self, t: pa.Table):
        """From the columns of FEATURES."""
        of = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        self.words, self.shape = of("words", np.uint32), np.array(of("shape", np.float64)).reshape(-1, SHAPE)
        self.meta = np.array(of("meta", np.int32)).reshape(-1, 3)

    def add(self, other: Rows) -> None:
        """Rows behind those there are."""
        self.words += other.words
        self.shape, self.meta = (np.concatenate(x) for x in ((self.shape, other.shape), (self.meta, other.meta)))

    def view(self, k: int, at: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k:
            return self.meta[at].ravel(), np.full(len(at), 3), np.zeros((len(at), 0))
        some = [self.words[i] for i in at]
        return known.of(np.concatenate([np.zeros(0, np.uint32), *some]), np.array([len(x) for x in some], np.int64), self.shape[at])


class CoTrained:
    """For one target: a classifier for each view, its calibration, and the prior."""

    def __init__(self, rows: Rows, y: np.ndarray):
        """y: 0 or 1, or NaN for rows without a label."""
        labelled = np.flatnonzero(~np.isnan(y))
        self.prior = float((np.nansum(y) + 1) / (len(labelled) + 2))
        self.fits = [(0.0, self.log_prior)] * 2
        self.known = Known(np.zeros(0, np.int64))
        self.views = [Linear(self.known.size, SHAPE), Linear(META, 0)]
        self.learns = len(np.unique(y[labelled])) == 2
        if not self.learns:
            return
        self.apart = labelled[::APART] if len(np.unique(y[labelled[::APART]])) == 2 else labelled
        train = np.setdiff1d(labelled, self.apart) if len(self.apart) < len(labelled) else labelled
        if len(np.unique(y[train])) < 2:
            train = labelled
        self.y = y[self.apart]
        #: Of each view: rows that it learns from, and their labels.
        self.taught = [(train, y[train])] * 2
        self.fit(rows)

    def fit(self, rows: Rows) -> None:
        """Both views, from what each is taught; the words that the text view knows are chosen first."""
        if not self.learns:
            return
        at, t = self.taught[0]
        self.known = Known(striking([rows.words[i] for i in at], t))
        self.views, self.fits = [], []
        for k in (0, 1):
            at, t = self.taught[k]
            model = Linear(*((self.known.size, SHAPE), (META, 0))[k]).fit(*rows.view(k, at, self.known), t, np.ones(len(at)))
            self.views.append(model)
            self.fits.append(calibration(model.logits(*rows.view(k, self.apart, self.known)), self.y))

    def teach(self, view: int, at: np.ndarray, labels: np.ndarray) -> None:
        """Rows, by number, that the other view has given labels to."""
        if self.learns and len(at):
            self.taught[view] = tuple(np.concatenate(x) for x in zip(self.taught[view], (at, labels)))

    def sure(self, views: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each view its log odds of rows; 0 where it isn't sure, because of the row rather than the prior."""
        out, limit = [], np.log(SURE / (1 - SURE))
        for (a, b), model, x in zip(self.fits, self.views, [self.known.of(*views[0]), views[1]]):
            z = a * model.logits(*x) + b
            gain = z - self.log_prior
            out.append(np.where(self.learns & (np.abs(z) > limit) & (z * gain > 0) & (np.abs(gain) > 1), z, 0.0))
        return out

    @property
    def log_prior(self) -> float:
        return float(np.log(self.prior / (1 - self.prior)))

    def scores(self, views: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities: what each calibrated view adds to the prior's log odds. views: words in all buckets with the shape, metadata."""
        views = [self.known.of(*views[0]), views[1]]
        z = np.full(len(views[0][1]), self.log_prior)
        for (a, b), model, x in zip(self.fits, self.views, views):
            z = z + a * model.logits(*x) + b - self.log_prior
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


FEATURES = "words binary, shape binary, meta binary"
#: Rows that are scored together.
ROWS = 1_024


def _views(column: pa.Array, extra: list[list]) -> Iterator[tuple[int, int, list]]:
    """(first row, end row, both views' features) of slices of a column of texts; extra: source, lang and n_chars of its rows."""
    held: list[tuple] = []
    for a, b, data, at, first, last in parts_of_rows(column):
        if first and last:
            words = text_features(data, at)
        else:  # of a long text, parts are summed
            held.append(text_sums(data, at))
            if not last:
                continue
            words = _shaped(*(np.unique(np.concatenate(x)) if k == 0 else np.sum(x, axis=0) for k, x in enumerate(zip(*held))))
            held = []
        meta = np.array([meta_buckets(*(c[i] for c in extra)) for i in range(a, b)]).ravel()
        yield a, b, [words, (meta, np.full(b - a, 3), np.zeros((b - a, 0)))]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FEATURES of rows behind their own columns other than those the views see."""
    for batch in batches:
        extra = [batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")]
        rest = [c for c in batch.schema.names if c not in ("text", "source", "lang", "n_chars")]
        for a, b, ((flat, counts, shape), (meta, _, _)) in _views(batch.column("text"), extra):
            cut = np.concatenate(([0], np.cumsum(counts)))
            words = [flat[x:y].astype(np.uint32).tobytes() for x, y in zip(cut, cut[1:])]
            metas = [x.astype(np.int32).tobytes() for x in meta.reshape(-1, 3)]
            shapes = [x.astype(np.float64).tobytes() for x in shape]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in rest] + [pa.array(x, pa.binary()) for x in (words, shapes, metas)], [*rest, "words", "shape", "meta"])


def _stored_views(batch: pa.RecordBatch) -> list[tuple]:
    """Both views' features of rows with FEATURES."""
    n = batch.num_rows
    words, at = buffers(batch.column("words"))
    of = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, -1)
    flat = np.frombuffer(words[at[0] : at[-1]].tobytes(), np.uint32).astype(np.int64)
    return [(flat, np.diff(at) // 4, of("shape", np.float64)), (of("meta", np.int32).ravel(), np.full(n, 3), np.zeros((n, 0)))]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and FEATURES of each row of docs (doc_id, text, source, lang, n_chars), as a table that all rounds read."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(by_arrow(rows, _featured, f"doc_id {kind}, h long, " + FEATURES))


#: A row that a view is sure of: target and view and label as one number, log odds, and the row's name.
SURE_OF = "code int, z double, doc_id long, h long"


def _confident(models: Broadcast):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                b = batch.slice(first, ROWS)
                ids, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
                views = _stored_views(b)
                for k, t in enumerate(TARGETS):
                    for view, z in enumerate(models.value[t].sure(views)):
                        at = np.flatnonzero(z)
                        code = k * 4 + view * 2 + (z[at] > 0)
                        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(np.abs(z[at])), pa.array(ids[at].astype(np.int64)), pa.array(h[at])], ["code", "z", "doc_id", "h"])

    return f


def _surest(sure: DataFrame, given: int) -> DataFrame:
    """Of each code the `given` rows with the greatest odds, ties by name: first in parts, then of what these leave."""
    order = [F.desc("z"), "doc_id", "h"]
    for parts in (["code", F.pmod(F.xxhash64("doc_id", "h"), F.lit(PARTS))], ["code"]):
        sure = sure.withColumn("k", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col("k") <= given).drop("k")
    return sure


def _sampled(rows: DataFrame) -> pa.Table:
    """Rows at the driver in an order that is always the same, and has nothing to do with their numbers, since every APART'th calibrates."""
    return rows.toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, features: DataFrame | None = None) -> dict[str, CoTrained]:
    """A model for each of TARGETS from about so many labelled rows, chosen by a hash of doc_id, and from all rows without a label.

    A doc_id with several labels counts as their mean, rounded; null labels are
    none, and rows without a doc_id take no part, nor do those of more than
    TAUGHT_BYTES. To the driver come the labelled rows' features, of at most about
    LABELLED_BYTES, and in each round at most GIVEN rows for each target, view and
    class. features: what featured() gives of docs.
    """
    spark = docs.sparkSession
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("fit8"), "doc_id"), 11) / F.lit(float(1 << 53))
    labels = labels.where("doc_id is not null")
    n_labels = labels.count()
    known = labels.where(draw < min(1.0, labelled / max(1, n_labels))).groupBy("doc_id").agg(*(F.round(F.avg(t)).alias(t) for t in TARGETS))
    named = (featured(docs) if features is None else features).where((F.col("doc_id").isNotNull()) & (F.octet_length("words") <= TAUGHT_BYTES))
    # at most about `labelled` rows
    some = named.join(F.broadcast(known), "doc_id")
    size = some.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size > LABELLED_BYTES:
        some = some.where(F.shiftrightunsigned(F.xxhash64(F.lit("bytes8"), "h"), 11) / F.lit(float(1 << 53)) < LABELLED_BYTES / size)
    t = _sampled(some)
    rows = Rows(t)
    models = {k: CoTrained(rows, t.column(k).to_numpy().astype(np.float64)) for k in TARGETS}
    # never more than ROUNDS * GIVEN rows for each target, view and class
    used = spark.createDataFrame([], "doc_id long, h long")
    for _ in range(ROUNDS):
        if not any(m.learns for m in models.values()):
            break
        now = spark.sparkContext.broadcast(models)
        sure = by_arrow(named, _confident(now), SURE_OF)
        sure = sure.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").join(F.broadcast(used), ["doc_id", "h"], "left_anti").distinct()
        best = _surest(sure, GIVEN).select("code", "doc_id", "h").toPandas().sort_values(["code", "doc_id", "h"])
        if not len(best):
            break
        names = spark.createDataFrame(sorted({(int(d), int(h)) for d, h in zip(best.doc_id, best.h)}), "doc_id long, h long")
        used = used.unionByName(names)
        got = _sampled(named.join(F.broadcast(names), ["doc_id", "h"], "left_semi"))
        place = {}
        for i, name in enumerate(zip(got.column("doc_id").to_pylist(), got.column("h").to_pylist())):
            place.setdefault(name, len(rows.words) + i)
        rows.add(Rows(got))
        for code, mine in best.groupby("code"):
            at = np.array([place[int(d), int(h)] for d, h in zip(mine.doc_id, mine.h)], np.int64)
            # what one view is sure of, the other learns
            models[TARGETS[code // 4]].teach(1 - code // 2 % 2, at, np.full(len(at), float(code % 2)))
        for m in models.values():
            m.fit(rows)
    return models


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score, toxic_score, kept for each row of docs (doc_id, text, source, lang, n_chars).

    kept: quality is likelier than not and toxicity is not. Null text is
    empty and null metadata values of their own; without labels of both classes
    a score is the prior of those there are; repeated rows are scored each; an
    empty table gives no rows; other columns are ignored. Of rows that a view is
    as sure of, those with the least doc_id teach. Long texts are looked at in
    parts; the features of all rows are a table that rounds and scores read.
    """
    spark = docs.sparkSession
    features = featured(docs)
    models = spark.sparkContext.broadcast(fit(docs, labels.select("doc_id", *TARGETS), features=features))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                b = batch.slice(first, ROWS)
                views = _stored_views(b)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(models.value[t].scores(views)) for t in TARGETS)], ["doc_id", "quality_score", "toxic_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = by_arrow(features, f, f"doc_id {kind}, quality_score double, toxic_score double")
    return out.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))
