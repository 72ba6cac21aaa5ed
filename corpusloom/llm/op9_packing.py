"""Order-preserving packing of token ids into windows by dynamic programming.

The documents of a partition keep their order. A window holds at most LENGTH
tokens and ends where a document or a sentence does; only a sentence that is
itself longer than a window may be cut inside. The cuts minimise padding plus
penalties for documents and sentences that are cut: best[j] = min over i with
x[j] - x[i] <= LENGTH of best[i] + LENGTH - (x[j] - x[i]) + penalty[j], whose
minimum of best[i] + x[i] over a sliding range is kept in a monotone queue.
Among the last LENGTH tokens of a partition every place is a candidate, and
windows there may also be powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm.common import LOWER, buffers, by_arrow, ragged, row_ranges, space_cuts

LENGTH, END_ID = 4096, 2
#: Penalties, in tokens of padding, of cutting a document at the end of a sentence, and a sentence inside.
SENTENCE_CUT, INNER_CUT = 2, 24
#: Steps between the places at which a sentence longer than a window may be cut.
INNER_STEP = 64
#: Tokens that are packed at once.
BLOCK = 1 << 19
#: Bytes of text encoded at once; words whose ids a Python worker remembers, and their bytes.
SLICE, MEMORY, MEMORY_BYTES = 1 << 23, 1_500_000, 1 << 26
#: New words given to the tokenizer at once.
LEARNED = 1_000


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b".,;:!?")] = True


def apart(texts: pa.Array) -> pa.Array:
    """Texts with a space between each letter A-Z, a-z and a mark behind it, and with A-Z in lower case: fewer distinct words, the same ids.

    A letter and such a mark never share a pretoken. Case is left alone where
    texts hold more than Latin-1, since case and composed letters may meet there.
    """
    data, at = buffers(texts)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        return texts
    if data.max() < 0xC4:
        data = LOWER[data]
    split = _MARK[data]
    split[1:] &= _LETTER[data[:-1]]
    split[0] = False
    split[at[:-1][at[:-1] < len(data)]] = False
    where = np.flatnonzero(split)
    out = np.insert(data, where, 0x20)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at + np.searchsorted(where, at)).astype(np.int32)), pa.py_buffer(out))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """Ids of texts by a `tokenizers` file whose pretokens never hold white space.

    The distinct words of apart() between ASCII white space are encoded once
    and remembered; ids of a text are those of its words, in order. A text that
    holds the string of a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        closing = [v for k, v in self.tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+[\"')]*</w>", k)]
        self.closing = np.zeros(max(self.tokenizer.get_vocab_size(), END_ID) + 1, bool)
        self.closing[closing] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)  # of each word's ids, and the end

    def _learned(self, new: pa.Array) -> None:
        """Remember the ids of new words, many of which are given to the tokenizer as one text and told apart by place."""
        flat, sizes = [self.flat], []
        words = new.to_pylist()
        for a in range(0, len(words), LEARNED):
            some = words[a : a + LEARNED]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begun = np.zeros(len(some), np.int64)
            np.cumsum([len(w) + 1 for w in some[:-1]], out=begun[1:])
            place = np.fromiter((x for x, _ in e.offsets), np.int64, len(e.offsets))
            flat.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(begun, place, "right") - 1, minlength=len(some)))
        self.words = pa.concat_arrays([self.words, new])
        self.flat = np.concatenate(flat)
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))))

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words in what is remembered."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            if len(self.words) + at.null_count > MEMORY or self.words.nbytes + words.nbytes > MEMORY_BYTES:
                self._forget()
                self._learned(words)
                return np.arange(len(words))
            self._learned(words.filter(at.is_null()))
            at = pc.index_in(words, value_set=self.words)
        return at.to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, unsigned 32-bit, and how many each text has."""
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            each = [self.encode(pa.array([x])) if not any(s in x for s in self.special) else self._whole(x) for x in texts.to_pylist()]
            return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])
        split = pc.ascii_split_whitespace(apart(texts))
        words = split.flatten().dictionary_encode()
        row = self._rows(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        count = self.start[row + 1] - self.start[row]
        ids = self.flat[ragged(self.start[row], count)]
        ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids, np.diff(ends, prepend=0)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return ids, np.array([len(ids)])

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, counts) of a column's rows, null as empty; a text longer than SLICE is cut at white space while it is encoded."""
        for a, b in row_ranges(column, SLICE):
            some = column.slice(a, b - a).fill_null("").cast(pa.string())
            if b - a == 1 and some.nbytes > SLICE:
                text = some[0].as_py()
                if not any(s in text for s in self.special):
                    parts = [self.encode(pa.array([x]))[0] for x in space_cuts(text, SLICE)]
                    ids = np.concatenate(parts)
                    yield a, ids, np.array([len(ids)])
                    continue
            yield a, *self.encode(some)


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def window_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH, free_from: int | None = None) -> list[int]:
    """Indices into places (increasing, from 0, steps of at most length) that end windows at least cost; the last is always one.

    Cost of a window: its padding up to length plus the penalty of its end. A
    window that ends beyond free_from has no padding either where it holds a
    power of two.
    """
    x = places.tolist()
    pen = penalties.tolist()
    n = len(x)
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    index = {p: i for i, p in enumerate(x) if free_from is not None and p >= free_from - length}
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    value = [0.0] * n  # best[i] + x[i], whose least over the range is at the queue's head
    for j in range(1, n):
        here = x[j]
        low = here - length
        while x[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        least = value[i] + length - here
        if index and here > free_from:
            for p in powers:
                k = index.get(here - p)
                if k is not None and best[k] < least:
                    i, least = k, best[k]
        best[j] = least + pen[j]
        back[j] = i
        v = best[j] + here
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray, length: int = LENGTH, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, and the penalty of each.

    ends: places where documents end; closing: flags of ids that end a
    sentence. The first and the last place are always among them, without a
    penalty. last: every place among the last `length` ids is one, too.
    """
    n = len(ids)
    kind = np.zeros(n + 1, np.uint8)
    kind[1:][closing[np.minimum(ids, len(closing) - 1)]] = 2
    kind[ends] = 3
    kind[0] = kind[n] = 3
    places = np.flatnonzero(kind)
    gap = np.diff(places)
    for k in np.flatnonzero(gap > length).tolist():  # sentences longer than a window
        inner = np.arange(places[k] + INNER_STEP, places[k + 1], INNER_STEP)
        kind[inner] = 1
    if last:
        tail = kind[max(0, n - length) :]
        tail[tail == 0] = 1
    places = np.flatnonzero(kind)
    return places, np.array([0.0, INNER_CUT, SENTENCE_CUT, 0.0])[kind[places]]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


class _Packer:
    """Packs documents as they come; sequence ids are unique by partition."""

    def __init__(self, partition: int, closing: np.ndarray):
        self.sequence = partition << 36
        self.closing = closing
        self.docs: list[tuple[int | None, int, int]] = []  # of held ids: doc_id, place of the first one in its document, doc_tokens
        self.held: list[np.ndarray] = []
        self.size = 0
        self.out: list[list[np.ndarray]] = [[] for _ in range(8)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for a in range(0, len(ids), BLOCK):  # a longer document comes in parts
            part = ids[a : a + BLOCK]
            self.docs.append((doc_id, a, len(ids)))
            self.held.append(part)
            self.size += len(part)
            if self.size >= BLOCK:
                self.pack(False)

    def pack(self, last: bool) -> None:
        """Pack what is held; unless it is the last, what the last window would hold stays for the next time."""
        if not self.held:
            return
        ids = np.concatenate(self.held)
        sizes = np.array([len(x) for x in self.held])
        ends = np.cumsum(sizes)
        begun, tokens = (np.array([d[k] for d in self.docs], np.int64) for k in (1, 2))
        whole = ends[begun + sizes == tokens]  # where documents end, not parts of them
        places, penalties = candidate_cuts(ids, whole, self.closing, LENGTH, last)
        cuts = places[window_cuts(places, penalties, LENGTH, len(ids) - LENGTH if last else None)]
        if not last:
            cuts = cuts[:-1]
        stop = int(cuts[-1]) if len(cuts) else 0
        starts = ends - sizes
        lo = np.unique(np.concatenate((starts, cuts, [0])))
        lo = lo[lo < stop]
        hi = np.append(lo[1:], stop)
        if len(lo):
            doc = np.searchsorted(ends, lo, "right")
            window = np.searchsorted(cuts, lo, "right")
            opened = np.concatenate(([0], cuts))
            n = np.diff(opened)
            pad = np.where(n & (n - 1) == 0, 0, LENGTH - n)
            data = ids.astype("<u4", copy=False)
            crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], np.int64)
            names = np.array([-1 if d[0] is None else d[0] for d in self.docs], np.int64)
            null = np.array([d[0] is None for d in self.docs])
            who = pa.array(names[doc], mask=null[doc])
            for column, x in zip(self.out, (who, begun[doc] + lo - starts[doc], hi - lo, crc, tokens[doc], self.sequence + window, lo - opened[window], pad[window])):
                column.append(x)
            self.sequence += len(cuts)
        docs, held, self.docs, self.held, self.size = self.docs, self.held, [], [], 0
        if not last:
            for (name, first, total), x, s in zip(docs, held, starts.tolist()):
                if s + len(x) > stop:
                    skip = max(0, stop - s)
                    self.docs.append((name, first + skip, total))
                    self.held.append(x[skip:].copy())
                    self.size += len(x) - skip

    def batch(self) -> pa.RecordBatch:
        out, self.out = self.out, [[] for _ in range(8)]
        whole = [pa.concat_arrays([pa.array(x).cast(pa.int64()) for x in c]) if c else pa.array([], pa.int64()) for c in out]
        return pa.RecordBatch.from_arrays(whole, [x.split()[0] for x in SCHEMA.split(", ")])


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text), by the tokenizer file at path, which executors must be able to read.

    A document is its ids and then END_ID; a null or empty text is END_ID
    alone. Each id lies in exactly one piece; windows are numbered by
    partition, in the order of the input. padded: what its sequence is padded
    by. Of cuts at one cost the first is taken. A text of any length is
    encoded in slices and packed in blocks. Repeated rows are packed each; an
    empty table gives no rows; other columns are ignored; a null doc_id stays null.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        packer = _Packer(TaskContext.get().partitionId(), encoder.closing)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, counts in encoder.rows(batch.column(1)):
                cut = np.concatenate(([0], np.cumsum(counts)))
                closed = np.full(len(ids) + len(counts), END_ID, np.uint32)
                closed[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                for k in range(len(counts)):
                    packer.add(names[first + k], closed[cut[k] + k : cut[k + 1] + k + 1])
                yield packer.batch()
        packer.pack(True)
        yield packer.batch()

    return by_arrow(docs.select("doc_id", "text"), f, SCHEMA)
