"""Toxicity by multiple-instance learning: documents carry labels, sentences carry the reason.

A document is a bag of sentences. Each sentence has a probability from the words
and letter n-grams in it; a document is toxic if any sentence is, so bags are
scored by noisy-or, 1 - prod(1 - p). The weights are fitted to documents' labels
through that, which leaves the sentences that explain a label with high
probabilities: these are located. Only rows that are not held out teach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BYTE_VALUES, by_arrow, lists, parts_of_rows, powers

#: Labelled rows that a model is fitted on, about, and bytes of their texts at most.
LABELLED, LABELLED_BYTES = 12_000, 48_000_000
#: Buckets of hashed features, and lengths in bytes of n-grams within words; whole words are features too.
BUCKETS, GRAMS = 1 << 20, (4, 5)
#: How far a feature's share of a class must be off to be known, in standard errors, and how many are known at most.
STRIKING, KNOWN = 4.0, 1 << 16
#: A sentence ends at . ! ? or a line's end, or after so many words.
LONGEST = 64
#: Probability from which a document is predicted toxic, and a sentence offends.
TOXIC, OFFENDS = 0.7, 0.5
#: Steps of fitting, their rate, and the spread that weights are expected to have around 0.
STEPS, RATE, SPREAD = 400, 0.1, 5.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


class Sentences:
    """Sentences of some rows: the row and the bytes of each, and the features of all by place."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.rows_n = len(at) - 1
        self.data = _FOLD[data]
        word = _LETTER[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at[:-1]] = True
        self.starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])) | word & edge[:-1])
        self.ends = np.flatnonzero(word & ~np.concatenate((word[1:], [False])) | word & edge[1:]) + 1
        row = np.searchsorted(at, self.starts, "right") - 1
        stops = np.cumsum(_STOP[data])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        new = np.ones(len(self.starts), bool)
        new[1:] = (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])
        first = np.flatnonzero(new)
        new |= (np.arange(len(new)) - np.repeat(first, np.diff(first, append=len(new)))) % LONGEST == 0
        #: Sentence of each word; row, first byte and end of each sentence.
        self.of_word = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.row = row[self.first]
        self.begin, self.end = self.starts[self.first], self.ends[np.append(self.first[1:], len(new)) - 1] if len(new) else self.starts
        self.n = len(self.first)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sentence, bucket) of words, then of n-grams of each length, repeats included."""
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(len(self.data)), out=prefix[1:])
        down = powers(len(self.data) + 1, "down")

        def bucket(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
            h = (prefix[b] - prefix[a]) * down[a] + np.uint64(seed)
            h ^= h >> np.uint64(29)
            return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64) % BUCKETS

        yield self.of_word, bucket(self.starts, self.ends, 0)
        sizes = self.ends - self.starts
        for n in GRAMS:
            count = np.maximum(0, sizes - n + 1)
            begun = np.cumsum(count) - count
            a = np.arange(int(count.sum())) + np.repeat(self.starts - begun, count)
            yield np.repeat(self.of_word, count), bucket(a, a + n, n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, ones, none): in how many toxic and other texts of a task each bucket is."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy().astype(np.int64)
        held: list[np.ndarray] = []
        for a, _, data, at, _, last in parts_of_rows(batch.column("text")):
            s = Sentences(data, at)
            found = [np.zeros(0, np.int64), *(s.row[of] * BUCKETS + b for of, b in s.features() if len(of))]
            held.append(np.unique(np.concatenate(found)))
            if last:
                pairs = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
                held = []
                np.add.at(counts, (toxic[a + pairs // BUCKETS], pairs % BUCKETS), 1)
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[1][some]), pa.array(counts[0][some])], ["bucket", "ones", "none"])


def striking(ones: np.ndarray, none: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Places where presence goes with a class, those that go most with it first and KNOWN at most."""
    n, all_ = ones + none, n1 + n0
    off = ones * (n0 / all_) - none * (n1 / all_)  # above what is to be expected
    z = np.abs(off) * np.sqrt(all_**3 / np.maximum(1.0, n * (all_ - n) * float(n0) * n1))
    order = np.lexsort((np.arange(len(z)), -z))[:KNOWN]
    return order[z[order] >= STRIKING]


class Model:
    """Weights of known features and what a sentence without any has; or a prior, where labels of a class are missing."""

    def __init__(self, buckets: np.ndarray, prior: float | None = None):
        self.table = np.full(BUCKETS, -1, np.int32)
        self.table[buckets] = np.arange(len(buckets))
        self.w, self.b, self.prior = np.zeros(len(buckets)), 0.0, prior

    def known(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature), distinct and in order, of features that are known."""
        size = max(1, len(self.w))
        found = [np.zeros(0, np.int64)]
        for of, bucket in s.features():
            k = self.table[bucket]
            on = k >= 0
            found.append(of[on] * size + k[on])
        pairs = np.unique(np.concatenate(found))
        return pairs // size, pairs % size

    def logits(self, s: Sentences) -> np.ndarray:
        of, k = self.known(s)
        return np.bincount(of, self.w[k], minlength=s.n) + self.b

    def fit(self, bag: np.ndarray, bags: int, of: np.ndarray, k: np.ndarray, plain: np.ndarray, y: np.ndarray) -> Model:
        """Noisy-or through to documents' labels, by Adam over all bags.

        bag: bag of each sentence that has known features; (of, k): its features;
        plain: number of other sentences in each bag; y: labels of bags.
        """
        n, theta = len(bag), np.zeros(len(self.w) + 1)
        prior = (y.sum() + 1) / (bags + 2)
        theta[-1] = np.log(prior) - np.log(max(1.0, (n + plain.sum()) / bags))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            z = np.bincount(of, theta[k], minlength=n) + theta[-1]
            p, p0 = _sigmoid(z), float(_sigmoid(theta[-1:])[0])
            # log of the probability that no sentence is toxic
            none = np.bincount(bag, -_softplus(z), minlength=bags) - plain * _softplus(theta[-1:])[0]
            # of a toxic document the loss is -log(1 - exp(none)), of another -none
            pull = np.where(y > 0, -np.exp(none) / np.maximum(1e-12, -np.expm1(none)), 1.0)
            dz = pull[bag] * p
            g = np.append(np.bincount(k, dz[of], minlength=len(self.w)), dz.sum() + (pull * plain).sum() * p0) / bags
            g[:-1] += theta[:-1] / (SPREAD**2 * bags)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.w, self.b = theta[:-1], float(theta[-1])
        return self


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _bagged(model: Model):
    """For each labelled text: the label, and its sentences' known features as (sentence, feature) pairs, sentences without any counted."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, b, data, at, _, _ in parts_of_rows(batch.column("text")):
                s = Sentences(data, at)
                of, k = model.known(s)
                row = s.row[of]
                sizes = np.bincount(row, minlength=b - a)
                plain = np.bincount(s.row, minlength=b - a) - np.bincount(s.row[np.unique(of)], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.array(toxic[a:b]), pa.array(plain), lists(of.astype(np.int32), sizes, pa.int32()), lists(k.astype(np.int32), sizes, pa.int32())],
                    ["row", "toxic", "plain", "sentences", "features"],
                )

    return f


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """A model from about so many labelled rows of docs (doc_id, text) that aren't held out, chosen by a hash of doc_id.

    Rows without a doc_id teach nothing, several labels of one doc_id count as
    their mean, rounded, null ones as none. The driver gets a count for each
    bucket and the known features of the labelled rows, whose texts have at most
    about LABELLED_BYTES.
    """
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("toxic"))
    named = named.where(~held_out("doc_id"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("fit12"), "doc_id"), 11) / F.lit(float(1 << 53))
    share = min(1.0, labelled / max(1, named.count()))
    # at most about `labelled` rows
    rows = docs.join(F.broadcast(named.where(draw < share)), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    if size > LABELLED_BYTES:
        # texts are dropped by their hash until the rest fits; a text that alone exceeds the bound teaches nothing
        keep = F.shiftrightunsigned(F.xxhash64(F.lit("bytes12"), "text"), 11) / F.lit(float(1 << 53)) < LABELLED_BYTES / size
        rows = rows.where(keep & (F.octet_length("text") <= LABELLED_BYTES))
    rows = rows.withColumn("toxic", (F.col("toxic") > 0).cast("int")).repartition(4)
    both = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = both.get(0, 0), both.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), (n1 + 1) / (n0 + n1 + 2))
    counts = by_arrow(rows, _counted, "bucket int, ones long, none long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("none").alias("none")).toArrow()
    bucket, ones, none = (counts.column(c).to_numpy() for c in ("bucket", "ones", "none"))
    order = np.argsort(bucket)
    model = Model(bucket[order][striking(ones[order], none[order], n1, n0)])
    bags = by_arrow(rows.withColumn("row", F.monotonically_increasing_id()), _bagged(model), "row long, toxic int, plain long, sentences array<int>, features array<int>").toArrow().combine_chunks()
    if not bags.num_rows:
        return Model(np.zeros(0, np.int64), (n1 + 1) / (n0 + n1 + 2))
    # parts of one text are a bag
    _, place, bag = np.unique(bags.column("row").to_numpy(), return_index=True, return_inverse=True)
    part = np.repeat(np.arange(bags.num_rows), np.diff(bags.column("sentences").chunk(0).offsets.to_numpy()))
    flat = lambda c: bags.column(c).chunk(0).flatten().to_numpy()
    key, of = np.unique(part * (1 << 32) + flat("sentences"), return_inverse=True)
    plain = np.bincount(bag, bags.column("plain").to_numpy(), minlength=len(place))
    return model.fit(bag[key >> 32], len(place), of, flat("features"), plain, bags.column("toxic").to_numpy()[place])


def held_out(doc_id: str):
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; a row without a doc_id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _scored(model: Model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none, total, worst, spans, base = 0.0, 0, (-1.0, 0), [], 0
            for a, b, data, at, begins, ends in parts_of_rows(batch.column("text")):
                s = Sentences(data, at)
                z = model.logits(s)
                p = _sigmoid(z)
                # characters before each byte of the slice
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                start, end = chars[s.begin] - chars[at[s.row]], chars[s.end] - chars[at[s.row]]
                sums = np.bincount(s.row, -_softplus(z), minlength=b - a)
                counts = np.bincount(s.row, minlength=b - a)
                bad = np.flatnonzero(p >= OFFENDS)
                if begins and ends:
                    out_none, out_n, where = sums, counts, s.row[bad]
                    out_spans = [dict(zip(("start", "end", "score"), x)) for x in zip(start[bad].tolist(), end[bad].tolist(), p[bad].tolist())]
                    best = np.lexsort((start, -p, s.row))
                    lead = best[np.flatnonzero(np.diff(s.row[best], prepend=-1))] if s.n else best
                    out_worst, out_place = np.zeros(b - a), np.full(b - a, -1)
                    out_worst[s.row[lead]], out_place[s.row[lead]] = p[lead], start[lead]
                else:  # parts of a long text are summed
                    if begins:
                        none, total, worst, spans, base = 0.0, 0, (-1.0, 0), [], 0
                    none, total = none + float(sums[0]), total + int(counts[0])
                    spans += [dict(zip(("start", "end", "score"), x)) for x in zip((start[bad] + base).tolist(), (end[bad] + base).tolist(), p[bad].tolist())]
                    if s.n and p.max() > worst[0]:
                        worst = (float(p.max()), int(start[p.argmax()]) + base)
                    base += int(chars[-1])
                    if not ends:
                        continue
                    out_none, out_n, out_spans, where = np.array([none]), np.array([total]), spans, np.zeros(len(spans), np.int64)
                    out_worst, out_place = np.array([max(0.0, worst[0])]), np.array([worst[1] if total else -1])
                score = -np.expm1(out_none) if model.prior is None else np.full(b - a, model.prior)
                at_row = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=b - a)))).astype(np.int32)
                spans_of = pa.ListArray.from_arrays(pa.array(at_row), pa.array(out_spans, SPAN))
                place = pa.array(out_place, pa.int64(), mask=out_place < 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(np.clip(score, 0, 1)), pa.array(out_n.astype(np.int64)), place, pa.array(out_worst), spans_of],
                    ["doc_id", "held_out", "score", "n_sentences", "worst_start", "worst_score", "offending"],
                )

    return f


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_start, worst_score, offending for each row of docs (doc_id, text).

    offending: (start, end, score) of each sentence with at least OFFENDS, in
    characters from 0, in order; worst_start: where the sentence with the greatest
    score begins, the first of several, null without any. labels (doc_id, toxic).
    A null or empty text and one without a word has no sentences and scores 0.
    Without labels of both classes each text, empty ones too, scores their
    smoothed share and none offends. Repeated rows are scored each; an empty table
    gives no rows; other columns are ignored. Texts of more than a megabyte are
    looked at in parts, whose ends also end a sentence.
    """
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic")))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scored(model.value)(batches)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id").alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, n_sentences long, worst_start long, worst_score double, offending array<struct<start:long,end:long,score:double>>"
    out = by_arrow(rows, f, schema)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_score", "offending")
