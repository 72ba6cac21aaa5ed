"""Katz backoff language model, learned from and applied to whole corpora.

Counts of words and of word pairs are discounted by Good-Turing. Every context
also keeps RESERVE of an occurrence for what it hasn't been seen with, so its
backoff weight is above zero and its distribution sums to one exactly:

  P(w)     = d1(c(w)) c(w) / (N + RESERVE); an unknown word gets the rest
  P(w | h) = d2(c(h w)) c(h w) / (c(h) + RESERVE) where the pair was seen,
             else alpha(h) P(w)
  alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w)), over words seen after h

One scan deals what runs of documents hold, sorted by word and context, to
shards by word. A shard counts its pairs, answers every run with the counts of
its words and pairs, and gives what its pairs add to their contexts; the
weights of contexts are made in shards by context. A token is then evaluated by
its run: by its pair where that was seen, else by its word and the weight of
its context. Frequent words are known before (their counts are broadcast) and
are dealt by pair; frequent pairs stay with their run.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, arrow_rows, by_arrow, dropped, mix, parts_of_rows, ragged, released, stored

#: Counts up to this are discounted.
DISCOUNTED = 5
#: What is kept of an occurrence in every context, and of the corpus for unknown words.
RESERVE = 0.5
#: Tokens and documents of a run, and bytes of text for each shard.
RUN_TOKENS, RUN_DOCS, SHARD_BYTES = 1_000_000, 30_000, 12_000_000
#: Words and pairs with more than one of so many tokens are frequent, if they occur so often: there are at most as many of them.
HOT_WORDS, HOT_PAIRS, HOT_LEAST = 5_000, 2_000, 2_000
#: Rows that are passed to Python workers at once; runs make rows of hundreds of kilobytes.
ROWS = 32
ADDED = 0.1
#: Hashes of the end of a text and of its start, which is only a context.
END, START = np.uint64(0xE0D0_0000_0000_0E0D), np.uint64(0x57A2_7000_0000_57A2)
#: Contexts are known by so many high bits of their hashes.
CODE_SHIFT = np.uint64(16)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of pairs, from the code of a context and the hash of a word."""
    return mix(h * _GOLD + mix(w))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 as compressed planes of bytes."""
    head, planes = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x).astype("<u8")
        wide = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), wide]
        planes.append(x.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    raw = b"".join(planes)
    return np.array([*head, len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays of packed(), unsigned 64-bit."""
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    head = np.frombuffer(blob, "<u8", 2 + 2 * n).tolist()
    raw = np.frombuffer(pa.decompress(blob[8 * len(head) :], decompressed_size=head[-1], codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for size, wide in zip(head[1:-1:2], head[2:-1:2]):
        x = np.zeros((size, 8), np.uint8)
        x[:, :wide] = raw[at : at + size * wide].reshape(wide, size).T
        out.append(x.view("<u8")[:, 0])
        at += size * wide
    return out


class _Run:
    """Tokens of some documents: words and then END for each, with the word before.

    A document's number is even if the model learns from it, else odd. A long
    text is in several runs: part is then its name, else null.
    """

    def __init__(self, place: int):
        self.place = place
        self.word: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.ids: list = []
        self.parts: list = []
        self.opened: list[bool] = []
        self.tokens = 0

    def add(self, ids: list, held: np.ndarray, data: np.ndarray, at: np.ndarray, part: int | None = None, first: bool = True, last: bool = True, carry: np.uint64 = START) -> np.uint64:
        """Returns the last word, which comes before the text's next part."""
        w = Words(data, at)
        per = np.diff(w.first)
        n = len(per)
        size = per + int(last)
        end = np.cumsum(size)
        word = np.full(int(end[-1]) if n else 0, END)
        is_word = np.ones(len(word), bool)
        if last:
            is_word[end - 1] = False
        word[is_word] = w.hashes
        before = np.empty_like(word)
        before[1:] = word[:-1]
        some = size > 0
        before[(end - size)[some]] = START if first else carry
        self.word.append(word)
        self.before.append(before)
        self.doc.append(np.repeat((np.arange(n, dtype=np.int64) + len(self.ids)) * 2 + held, size))
        self.ids += ids
        self.parts += [part] * n
        self.opened += [first] * n
        self.tokens += len(word)
        return word[-1] if len(word) else carry

    def sorted(self) -> tuple[np.ndarray, ...]:
        """Entries (word, context, document, how often) in order, and where pairs begin among them; the words and contexts of pairs."""
        word, before, doc = (np.concatenate(x) for x in (self.word, self.before, self.doc))
        names, rank = np.unique(np.concatenate((word, before)), return_inverse=True)
        n = len(word)
        wide = max(1, int(len(names) - 1).bit_length())
        deep = max(1, int(doc.max()).bit_length())
        if 2 * wide + deep > 64:
            raise ValueError("a run has more than 2 ** 24 different words")
        w, d = np.uint64(wide), np.uint64(deep)
        key = np.sort(((rank[:n].astype(np.uint64) << w | rank[n:].astype(np.uint64)) << d) | doc.astype(np.uint64))
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        often = np.diff(first, append=n)
        key = key[first]
        pair = key >> d
        begun = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        pair = pair[begun]
        return (key & np.uint64((1 << deep) - 1)).astype(np.int64), often, begun, names[(pair >> w).astype(np.int64)], names[(pair & np.uint64((1 << wide) - 1)).astype(np.int64)]

    def name(self) -> int:
        """A hash of the run's place and of all it holds, so that runs that were cut otherwise never meet."""
        said = hashlib.blake2b(repr((TaskContext.get().partitionId(), self.place, self.ids, self.parts)).encode(), digest_size=8)
        for x in (*self.word, *self.doc):
            said.update(x.tobytes())
        return int.from_bytes(said.digest(), "little") >> 1


def _runs(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[_Run]:
    run, part = _Run(0), None
    again: dict = {}  # how often a document's name came with a long text
    for batch in batches:
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(np.int64)
        carry = START
        for a, b, data, at, first, last in parts_of_rows(batch.column("text")):
            ids = batch.column("doc_id").slice(a, b - a).to_pylist()
            whole = first and last
            if first and not whole:
                again[ids[0]] = again.get(ids[0], 0) + 1
                part = int.from_bytes(hashlib.blake2b(repr((TaskContext.get().partitionId(), ids[0], again[ids[0]])).encode(), digest_size=8).digest(), "little") >> 1
            carry = run.add(ids, held[a:b], data, at, None if whole else part, first, last, carry)
            if run.tokens >= tokens or len(run.ids) >= RUN_DOCS:
                yield run
                run = _Run(run.place + 1)
    if run.ids:
        yield run


def _words_counted(tokens: int, share: int):
    """Counts of the words of each run (h null), and of its pairs that are frequent there."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, tokens):
            word, before = np.concatenate(run.word), np.concatenate(run.before)
            names, rank, n = np.unique(np.concatenate((word, before)), return_inverse=True, return_counts=True)
            n = np.bincount(rank[: len(word)], minlength=len(names))
            seen = n > 0
            # only pairs of frequent words can be frequent
            least = max(2, len(word) // share)
            often = n >= least
            on = often[rank[: len(word)]]
            pair, m = np.unique(rank[: len(word)][on].astype(np.uint64) << np.uint64(32) | rank[len(word) :][on].astype(np.uint64), return_counts=True)
            pair, m = pair[m >= least], m[m >= least]
            w, h = names[(pair >> np.uint64(32)).astype(np.int64)], names[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            key = np.concatenate((names[seen], w)).view(np.int64)
            context = pa.concat_arrays([pa.nulls(int(seen.sum()), pa.int64()), pa.array(h.view(np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(key), context, pa.array(np.concatenate((n[seen], m)).astype(np.int64))], ["w", "h", "n"])

    return f


ROW = "kind int, shard int, run long, payload binary, ids array<long>, parts array<long>, opened array<boolean>, h long, doc int, n long"
_TYPES = dict(kind=pa.int32(), shard=pa.int32(), run=pa.int64(), payload=pa.binary(), ids=pa.list_(pa.int64()), parts=pa.list_(pa.int64()), opened=pa.list_(pa.bool_()), h=pa.int64(), doc=pa.int32(), n=pa.int64())
#: Kinds of rows: what a run deals to a shard; the answer; what a shard's pairs add to contexts; the documents of a run; a run's
#: frequent pairs; counts of counts, and of frequent pairs from COUNTED on; occurrences of pairs that weren't seen; weights of contexts for documents.
DEALT, ANSWER, CONTEXTS, DOCS, FREQUENT, COUNTS, UNSEEN, WEIGHTS = range(1, 9)
COUNTED = 1_000


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _TYPES.items()], list(_TYPES))


def _plain(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays([pa.array(columns[k]).cast(t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], list(_TYPES))


class Frequent:
    """Frequent words with their counts, and frequent pairs: both bounded, both broadcast."""

    def __init__(self, words: dict[int, int], pairs: list[tuple[int, int]]):
        unsigned = lambda x: np.array(x, np.int64).view(np.uint64)
        self.words = unsigned(list(words))
        order = np.argsort(self.words)
        self.words, self.counts = self.words[order], np.array(list(words.values()), np.int64)[order]
        w, h = unsigned([p[0] for p in pairs]), unsigned([p[1] for p in pairs])
        self.keys = pair_keys(h >> CODE_SHIFT, w)
        order = np.argsort(self.keys)
        self.keys, self.w, self.h = self.keys[order], w[order], h[order]

    @staticmethod
    def place(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where keys are among sorted ones, or -1."""
        if not len(have):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(have, keys)
        at[at == len(have)] = 0
        return np.where(have[at] == keys, at, -1)


def _dealt(shards: int, frequent, tokens: int):
    """A run's words and pairs with the documents they are in, by shard."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for run in _runs(batches, tokens):
            name = run.name()
            # the number of tokens is that of all entries, which shows whether the run came whole
            rows = [dict(kind=DOCS, shard=name % shards, run=name, ids=run.ids, parts=run.parts, opened=run.opened, n=run.tokens)]
            if run.tokens:
                doc, often, begun, w, h = run.sorted()
                size = np.diff(begun, append=len(doc))
                code = h >> CODE_SHIFT
                key = pair_keys(code, w)
                common = hot.place(hot.words, w) >= 0
                kept = hot.place(hot.keys, key)
                shard = np.where(common, shard_of(key, shards), shard_of(w, shards))
                on = np.flatnonzero(kept >= 0)
                if len(on):
                    at = ragged(begun[on], size[on])
                    rows.append(dict(kind=FREQUENT, shard=name % shards, run=name, payload=packed(kept[on], size[on], doc[at], often[at])))
                rest = np.flatnonzero(kept < 0)
                rest = rest[np.argsort(shard[rest], kind="stable")]
                cut = np.searchsorted(shard[rest], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    p = rest[cut[s] : cut[s + 1]]
                    new = np.flatnonzero(np.diff(w[p], prepend=~w[p[:1]]))
                    at = ragged(begun[p], size[p])
                    rows.append(dict(kind=DEALT, shard=s, run=name, payload=packed(w[p][new], np.diff(new, append=len(p)), code[p], size[p], doc[at], often[at])))
            for a in range(0, len(rows), ROWS):
                yield _batch(rows[a : a + ROWS])

    return f


def _one_by_one(batch: pa.RecordBatch, names: list[str]) -> Iterator[list]:
    """Rows of a batch, whose large values are copied only while they are used."""
    for i in range(batch.num_rows):
        yield [batch.column(c)[i].as_py() for c in names]


def _grouped(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by group; exact below 2 ** 53."""
    return np.bincount(group, values, minlength=n).astype(np.uint64)


class _Shard:
    """The words of a shard, as its runs deal them."""

    def __init__(self):
        self.runs: list[int] = []
        self.blobs: list[bytes] = []

    def settled(self, hot: Frequent, shards: int) -> Iterator[pa.RecordBatch]:
        keys, taught, codes, word_of, words, word_taught = [], [], [], [], [], []
        at_word = 0
        for blob in self.blobs:
            w, of_word, code, size, doc, often = unpacked(blob)
            of_word, size = of_word.astype(np.int64), size.astype(np.int64)
            mine = np.repeat(np.arange(len(w)), of_word)
            n = np.add.reduceat(np.where(doc & np.uint64(1), 0, often), np.cumsum(size) - size).astype(np.int64)
            keys.append(pair_keys(code, w[mine]))
            taught.append(n)
            codes.append(code)
            word_of.append((mine + at_word).astype(np.int32))
            words.append(w)
            word_taught.append(np.add.reduceat(n, np.cumsum(of_word) - of_word))
            at_word += len(w)
        sizes = [len(k) for k in keys]
        words, word_taught = np.concatenate(words), np.concatenate(word_taught)
        names, back = np.unique(words, return_inverse=True)
        count = _grouped(word_taught, back, len(names)).astype(np.int64)
        common = hot.place(hot.words, names)
        count[common >= 0] = hot.counts[common[common >= 0]]
        of_word = count[back]
        _, first, pair = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        del keys
        pair_count = _grouped(np.concatenate(taught), pair, len(first)).astype(np.int64)
        del taught
        codes, word_of = np.concatenate(codes), np.concatenate(word_of)
        # counts of counts
        of = np.bincount(np.minimum(pair_count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        yield _plain(COUNTS, h=np.arange(1, DISCOUNTED + 2), n=of[1 : DISCOUNTED + 2])
        # what is added to contexts
        seen = np.flatnonzero(pair_count)
        some = (common < 0) & (count > 0) & (names != END)
        yield from _added(codes[first[seen]], pair_count[seen], of_word[word_of[first[seen]]], names[some] >> CODE_SHIFT, count[some], shards)
        # answers
        at_pair = at_word = 0
        for k, (run, blob) in enumerate(zip(self.runs, self.blobs)):
            w, per, code, size, doc, often = unpacked(blob)
            c2 = pair_count[pair[at_pair : at_pair + sizes[k]]]
            c = of_word[at_word : at_word + len(w)]
            # a word that is no context has an odd number
            yield _batch([dict(kind=ANSWER, run=run, payload=packed(c << 1 | (w == END), per, c2, size, doc, often))])
            size = size.astype(np.int64)
            odd = np.flatnonzero(c2 == 0)
            at = ragged(np.cumsum(size)[odd] - size[odd], size[odd])
            if len(at):
                yield _plain(UNSEEN, h=np.repeat(code[odd], size[odd]).astype(np.int64), run=np.full(len(at), run), doc=doc[at].astype(np.int64), n=often[at].astype(np.int64))
            at_pair += sizes[k]
            at_word += len(w)


def _added(code: np.ndarray, pair: np.ndarray, word: np.ndarray, own: np.ndarray, own_count: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Sums by context: pairs by count up to DISCOUNTED and the sum of larger counts, the same of their words, and occurrences; by shard of the context.

    code, pair, word: of each pair the context, its count, and its word's;
    own, own_count: contexts and how often they occur.
    """
    contexts, at = np.unique(np.concatenate((code, own)), return_inverse=True)
    n, at, own_at = len(contexts), at[: len(code)], at[len(code) :]
    sums = []
    for x in (pair, word):
        sums += [np.bincount(at[x == r], minlength=n) for r in range(1, DISCOUNTED + 1)]
        sums.append(_grouped(np.where(x > DISCOUNTED, x, 0), at, n))
    sums.append(_grouped(own_count, own_at, n))
    # codes have 48 bits
    cut = np.searchsorted(shard_of(contexts << CODE_SHIFT, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        o = slice(cut[s], cut[s + 1])
        yield _batch([dict(kind=CONTEXTS, shard=s, payload=packed(contexts[o], *(x[o] for x in sums)))])


def _settled(shards: int, frequent):
    """From rows sorted by shard: answers, contexts, counts; documents and frequent pairs of runs pass through."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        of_pair = np.zeros(len(hot.keys), np.int64)
        now, held = None, _Shard()
        for batch in batches:
            for i, (kind, shard, run) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "run")))):
                if kind != DEALT:
                    yield batch.slice(i, 1)
                    if kind == FREQUENT:
                        which, size, doc, often = unpacked(batch.column("payload")[i].as_py())
                        size = size.astype(np.int64)
                        of_pair[which.astype(np.int64)] += np.add.reduceat(np.where(doc & np.uint64(1), 0, often), np.cumsum(size) - size).astype(np.int64)
                    continue
                if shard != now:
                    if held.runs:
                        yield from held.settled(hot, shards)
                    now, held = shard, _Shard()
                held.runs.append(run)
                held.blobs.append(batch.column("payload")[i].as_py())
        if held.runs:
            yield from held.settled(hot, shards)
        at = np.flatnonzero(of_pair)
        yield _plain(COUNTS, h=at + COUNTED, n=of_pair[at])

    return f


def discounts(of: dict[int, int], k: int = DISCOUNTED) -> list[float]:
    """Katz's factors d[1..k] from counts of counts; d[0] is unused.

    Where these don't give falling positive factors (small or odd corpora), the
    factors are those of one absolute discount.
    """
    n = [0] + [of.get(r, 0) for r in range(1, k + 2)]
    if min(n[1:]) > 0:
        cut = (k + 1) * n[k + 1] / n[1]
        if cut < 1:
            d = [1.0] + [((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d[1:]):
                return d
    most = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    most = min(0.9, max(0.1, most))
    return [1.0] + [(r - most) / r for r in range(1, k + 1)]


class Totals:
    """What the whole corpus gives: tokens, distinct ones, documents, and the discount factors of words and pairs."""

    def __init__(self, total: int, size: int, docs: int, of_words: dict[int, int]):
        self.total, self.size, self.docs = total, size, docs
        self.d1, self.d2 = np.array(discounts(of_words)), np.ones(DISCOUNTED + 1)
        kept = sum(n * r * self.d1[r] for r, n in of_words.items() if r <= DISCOUNTED)
        large = total - sum(n * r for r, n in of_words.items() if r <= DISCOUNTED)
        self.unknown = 1 - (kept + large) / (total + RESERVE)

    @staticmethod
    def cut(n: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return n * d[np.where(n > DISCOUNTED, 0, n)]

    def log_p(self, n: np.ndarray) -> np.ndarray:
        """Log probabilities of words that occur so often."""
        p = self.cut(n, self.d1) / (self.total + RESERVE)
        return np.log10(np.where(n > 0, p, self.unknown))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADDED) / (self.total + ADDED * (self.size + 1)))


def _weighed(totals: Totals):
    """From sums by context, sorted by shard: (h, weight), log alpha(h) + log(c(h) + RESERVE)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.arange(1, DISCOUNTED + 1)

        def made(blobs: list[bytes]) -> pa.RecordBatch:
            parts = [unpacked(b) for b in blobs]
            h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = [np.bincount(back, np.concatenate([p[k] for p in parts]), minlength=len(h)) for k in range(1, len(parts[0]))]
            k = DISCOUNTED + 1
            seen = sum(x * y * d for x, y, d in zip(sums[:DISCOUNTED], r, totals.d2[1:])) + sums[k - 1]
            lower = sum(x * y * d for x, y, d in zip(sums[k : k + DISCOUNTED], r, totals.d1[1:])) + sums[2 * k - 1]
            c = sums[2 * k] + RESERVE
            weight = np.log10((1 - seen / c) / (1 - lower / (totals.total + RESERVE))) + np.log10(c)
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(weight)], ["h", "weight"])

        now, blobs = None, []
        for batch in batches:
            for shard, blob in _one_by_one(batch, ["shard", "payload"]):
                if shard != now and blobs:
                    yield made(blobs)
                    blobs = []
                now = shard
                blobs.append(blob)
        if blobs:
            yield made(blobs)

    return f


SCORED = "doc_id long, part long, n_tokens long, n_known long, base_score double, score double"


def _together(totals: Totals, frequent, of_pairs: np.ndarray):
    """From rows sorted by run: the scores of its documents, token by token."""
    log_start = math.log10(totals.docs + RESERVE) if totals.docs else 0.0

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        now, ids, tokens = None, None, 0
        sums: dict[str, np.ndarray] = {}

        def add(doc: np.ndarray, **values: np.ndarray) -> None:
            for k, v in values.items():
                x = np.bincount(doc, v)
                if len(x) > len(sums[k]):
                    sums[k] = np.concatenate((sums[k], np.zeros(2 * len(x) - len(sums[k]))))
                sums[k][: len(x)] += x

        def scores(c: np.ndarray, is_context: np.ndarray, c2: np.ndarray, per: np.ndarray, size: np.ndarray, doc: np.ndarray, often: np.ndarray) -> None:
            """Words with counts c, per of whose pairs with counts c2 have size entries each."""
            log_p, base = totals.log_p(c), totals.base(c)
            # as a context, a word divides what comes after it
            later = np.where(is_context & (c > 0), np.log10(c + RESERVE), 0.0)
            word = np.repeat(np.arange(len(c)), per)
            seen = c2 > 0
            value = np.where(seen, np.log10(np.where(seen, totals.cut(c2, totals.d2), 1.0)), log_p[word]) - later[word]
            of, at = np.repeat(word, size), np.repeat(np.arange(len(c2)), size)
            add(doc, tokens=often, known=np.where(c[of] > 0, often, 0), base=often * base[of], score=often * value[at])

        def out() -> pa.RecordBatch:
            if int(sums["tokens"].sum()) != tokens:
                raise RuntimeError("the rows of a run came from different attempts at it")
            n = len(ids["ids"])
            x = {}
            for k, v in sums.items():  # of a document's two numbers one is in use
                v = np.concatenate((v, np.zeros(max(0, 2 * n - len(v)))))[: 2 * n]
                x[k] = v[0::2] + v[1::2]
            score = x["score"] - np.where(np.array(ids["opened"], bool), log_start, 0.0)
            columns = [pa.array(ids["ids"], pa.int64()), pa.array(ids["parts"], pa.int64()), *(pa.array(x[k].astype(np.int64)) for k in ("tokens", "known")), pa.array(x["base"]), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

        for batch in batches:
            for kind, run, payload, who, parts, opened, n, weights in _one_by_one(batch, ["kind", "run", "payload", "ids", "parts", "opened", "n", "weights"]):
                if run != now:
                    if now is not None:
                        yield out()
                    now, ids, tokens = run, dict(ids=[], parts=[], opened=[]), 0
                    sums = {k: np.zeros(1024) for k in ("tokens", "known", "base", "score")}
                if kind == DOCS:
                    ids, tokens = dict(ids=who, parts=parts, opened=opened), n
                elif kind == WEIGHTS:
                    add(np.array([x["doc"] for x in weights]), score=np.array([x["weight"] for x in weights]))
                elif kind == ANSWER:
                    c, per, c2, size, doc, often = (x.astype(np.int64) for x in unpacked(payload))
                    scores(c >> 1, c & 1 == 0, c2, per, size, doc, often)
                else:
                    which, size, doc, often = (x.astype(np.int64) for x in unpacked(payload))
                    w = hot.w[which]
                    scores(hot.counts[hot.place(hot.words, w)], w != END, of_pairs[which], np.ones(len(which), np.int64), size, doc, often)
        if now is not None:
            yield out()

    return f


def trained_on(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) != 0, F.lit(True))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    The model learns from rows that aren't held out. A null or empty text is
    its end alone; an unknown word has the one probability that discounting
    frees; repeated rows are learned and scored each; an empty table gives
    none; a null doc_id is learned from; other columns are ignored. A long text
    is scored in parts.
    """
    spark = docs.sparkSession
    held = ~trained_on("doc_id")
    text = docs.select("doc_id", "text", held.alias("held"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, int(size // SHARD_BYTES))
    few = max(16, shards // 4)  # of contexts

    counted = by_arrow(text.where("not held"), _words_counted(RUN_TOKENS, HOT_PAIRS), "w long, h long, n long")
    counted = stored(counted.groupBy("w", "h").agg(F.sum("n").alias("n")))
    words = counted.where("h is null")
    x = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("w") == int(END.astype(np.int64)), F.col("n"))).alias("docs"), *(F.count_if(F.col("n") == r).alias(f"of{r}") for r in range(1, DISCOUNTED + 2))).first()
    totals = Totals(x.n or 0, x.v, x.docs or 0, {r: x[f"of{r}"] for r in range(1, DISCOUNTED + 2)})
    # at most HOT_WORDS and 2 * HOT_PAIRS rows
    common = {r.w: r.n for r in words.where(F.col("n") >= max(HOT_LEAST, totals.total / HOT_WORDS)).collect()}
    pairs = counted.where(F.col("h").isNotNull() & (F.col("n") >= max(HOT_LEAST, totals.total / (2 * HOT_PAIRS)))).select("w", "h").collect()
    hot = Frequent(common, [(r.w, r.h) for r in pairs if r.w in common])
    frequent = spark.sparkContext.broadcast(hot)
    dropped(counted)
    released(spark)

    dealt = by_arrow(text, _dealt(shards, frequent, RUN_TOKENS), ROW)
    with arrow_rows(spark, ROWS):
        parts = stored(by_arrow(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard"), _settled(few, frequent), ROW))
    released(spark)
    of_pairs, of = np.zeros(len(hot.keys), np.int64), {}
    for r in parts.where(F.col("kind") == COUNTS).groupBy("h").agg(F.sum("n").alias("n")).collect():
        if r.h >= COUNTED:
            of_pairs[r.h - COUNTED] = r.n
        else:
            of[r.h] = r.n
    for n in of_pairs.tolist():
        of[n] = of.get(n, 0) + 1
    totals.d2 = np.array(discounts(of))
    # what frequent words and pairs add to contexts
    seen = of_pairs > 0
    own = np.append(hot.words[hot.words != END], [START] if totals.docs else np.zeros(0, np.uint64)) >> CODE_SHIFT
    own_count = np.append(hot.counts[hot.words != END], [totals.docs] if totals.docs else np.zeros(0, np.int64))
    more = list(_added(hot.h[seen] >> CODE_SHIFT, of_pairs[seen], hot.counts[hot.place(hot.words, hot.w[seen])], own, own_count, few))
    more = spark.createDataFrame([(s, bytes(p)) for b in more for s, p in zip(b.column("shard").to_pylist(), b.column("payload").to_pylist())], "shard int, payload binary")
    added = parts.where(F.col("kind") == CONTEXTS).select("shard", "payload").unionByName(more)
    with arrow_rows(spark, ROWS):
        contexts = stored(by_arrow(added.repartitionById(few, "shard").sortWithinPartitions("shard"), _weighed(totals), "h long, weight double"))
    # contexts that are frequent words are joined by broadcast: at most HOT_WORDS and START
    which = F.broadcast(spark.createDataFrame([(int(x),) for x in own], "h long"))
    unseen = parts.where(F.col("kind") == UNSEEN).select("run", "doc", "n", "h")
    often = unseen.join(F.broadcast(contexts.join(which, "h", "left_semi")), "h")
    rest = unseen.join(which, "h", "left_anti").join(contexts.join(which, "h", "left_anti"), "h")
    weights = often.unionByName(rest).groupBy("run", "doc").agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))
    # at most RUN_DOCS in a run
    weights = weights.groupBy("run").agg(F.collect_list(F.struct("doc", "weight")).alias("weights"))
    rows = parts.where(F.col("kind").isin(ANSWER, DOCS, FREQUENT)).select("kind", "run", "payload", "ids", "parts", "opened", "n")
    rows = rows.unionByName(weights.withColumn("kind", F.lit(WEIGHTS)), allowMissingColumns=True)
    with arrow_rows(spark, ROWS):
        out = stored(by_arrow(rows.repartition("run").sortWithinPartitions("run"), _together(totals, frequent, of_pairs), SCORED))
    dropped(parts)
    dropped(contexts)
    released(spark)
    whole = out.where("part is null").drop("part")
    long = out.where("part is not null").groupBy("part").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))).drop("part")
    out = whole.unionByName(long)
    return out.select("doc_id", (~trained_on("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(totals.total).cast("long").alias("train_tokens"), "base_score", "score")
