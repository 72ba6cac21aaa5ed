"""SentencePiece encoding and decoding by a streaming Viterbi search.

A BPE piece model is searched as a lattice: for each place of a text, the
backpointer goes to the one piece that can stand last before it, which is the
piece that no merge across its left edge would have taken apart. (Pieces
follow each other in an encoding exactly if each neighbouring pair is its own
encoding.) Only a window of the longest piece's length is kept: ids are
committed as soon as all paths that survive in it go through one boundary,
as they do at every change between letters, digits and other characters. So a
text falls into parts, each of which is searched by itself; distinct parts of
many texts are searched once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusloom.llm.common import buffers, lists, ragged, row_ranges

SPACE = "▁"
#: Bytes of text encoded at once; parts whose ids a Python worker remembers, and their bytes; pairs of pieces that it remembers.
SLICE, MEMORY, MEMORY_BYTES, PAIRS = 1 << 22, 1_000_000, 1 << 25, 400_000
#: Characters between two looks for a boundary that all paths share.
STEP = 64

# Latin letters, digits, and all other characters
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u1e00-\u1eff"
_CLASSES = rf"(?:[{_LATIN}]+|[0-9]+|[^{_LATIN}0-9{SPACE}]+)"
_OTHER, _LETTER, _DIGIT, _GAP = range(4)
_OF_BYTE = np.zeros(256, np.uint8)
_OF_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_OF_BYTE[0x30:0x3A] = _DIGIT
_OF_BYTE[0x20] = _GAP
_OF_BYTE[0xC4:0xC9] = _LETTER  # U+0100 to U+023F


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character, as _CLASSES has it."""
    out = _OF_BYTE[data]
    if not len(data) or data.max() < 0x80:
        return out
    after = np.append(data[1:], [0]).astype(np.uint8)
    out[(data == 0xC3) & (after != 0x97) & (after != 0xB7)] = _LETTER  # but for the signs of multiplication and division
    out[(data == 0xC9) & (after < 0x90)] = _LETTER
    out[(data == 0xE1) & (after >= 0xB8) & (after <= 0xBB)] = _LETTER
    bar = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))  # U+2581
    out[bar] = _GAP
    inside = np.flatnonzero((data & 0xC0) == 0x80)
    for _ in range(3):
        out[inside] = out[inside - 1]
    return out


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A BPE model with byte fallback from a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.ids: dict[str, int] = {}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        score = [0.0] * n
        for i in range(n):
            if sp.is_byte(i):
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i)
                self.ids[p], score[i] = i, sp.get_score(i)
                self.text[i] = p.replace(SPACE, " ").encode()
        self.prefixed = bool(sp.encode("a")) and sp.id_to_piece(sp.encode("a")[0]).startswith(SPACE)
        # rank: the order in which merges are made
        self.rank = [0] * n
        for r, i in enumerate(sorted(self.ids.values(), key=lambda i: -score[i])):
            self.rank[i] = r
        self.name = {i: p for p, i in self.ids.items()}
        self.most = max(map(len, self.ids), default=1)
        self.sides: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.whole = bytearray(n)
        for p, i in self.ids.items():
            self.whole[i], self.sides[i] = self._last_merge(p, i)
        single = re.compile(rf"{SPACE}*{_CLASSES}?")
        # pieces of one class each: paths meet wherever the class changes
        self.apart = all(single.fullmatch(p) for p in self.ids)
        self.fit: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.parts = pa.array([], pa.binary())
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)  # of each part's ids, and the end

    def _last_merge(self, p: str, i: int) -> tuple[bool, tuple[int, int]]:
        """Whether merging its characters gives the piece itself, and the two pieces of the last merge."""
        symbols, sides = list(p), (i, i)
        while len(symbols) > 1:
            best = min(((self.rank[j], k) for k in range(len(symbols) - 1) if (j := self.ids.get(symbols[k] + symbols[k + 1])) is not None), default=None)
            if best is None:
                return False, (i, i)
            k = best[1]
            if len(symbols) == 2:
                sides = (self.ids[symbols[0]], self.ids[symbols[1]])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return True, sides

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand behind piece a: no merge across the edge comes before those that make a and b."""
        key = a << 20 | b
        found = self.fit.get(key)
        if found is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            found = self.fit[key] = self._follows(a, b)
        return found

    def _follows(self, a: int, b: int) -> bool:
        ids, name, rank, sides = self.ids, self.name, self.rank, self.sides
        limit = 1 << 60  # merges of at least this rank come too late
        while True:
            c = ids.get(name[a] + name[b])
            if c is not None and rank[c] < limit:
                return False
            # undo the later one of the merges that made a and b
            left, right = sides[a][1], sides[b][0]
            if left == a and right == b:
                return True
            if right == b or (left != a and rank[a] > rank[b]):
                limit, a = rank[a], left
            else:
                limit, b = rank[b] + 1, right

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]

    def search(self, part: str) -> Iterator[int]:
        """Ids of a part, committed as the paths meet."""
        ids, follows, most = self.ids, self.follows, self.most
        base = 0  # what is before is committed
        last: list[int] = [-1]  # of places from base on: the piece that ends there, -1 at a fresh start
        back: list[int] = [0]
        for end in range(1, len(part) + 1):
            i = end - base
            for size in range(min(i, most), 0, -1):
                t = ids.get(part[end - size : end])
                if t is not None:
                    u = last[i - size]
                    if (u < 0 and self.whole[t] and u != -2) or (u >= 0 and follows(u, t)):
                        last.append(t)
                        back.append(i - size)
                        break
            else:
                last.append(-2)
                back.append(i)
                if part[end - 1] not in ids:  # no piece goes over it: all paths end here
                    yield from self._path(last, back, i - 1)
                    yield from self._fallback(part[end - 1])
                    base, last, back = end, [-1], [0]
                    continue
            if i >= STEP + most and not i % STEP:
                # surviving paths end in the last `most` places; walk back until one boundary is left
                open_ = {k for k in range(i - most + 1, i + 1) if last[k] >= 0}
                while len(open_) > 1:
                    k = max(open_)
                    open_.remove(k)
                    open_.add(back[k])
                k = open_.pop()
                if k:
                    yield from self._path(last, back, k)
                    base += k
                    # the boundary's piece is kept to judge what follows it
                    last, back = [last[k], *last[k + 1 :]], [0, *(max(0, b - k) for b in back[k + 1 :])]
        yield from self._path(last, back, len(last) - 1)

    @staticmethod
    def _path(last: list[int], back: list[int], i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def _learned(self, new: pa.Array) -> None:
        """Search new parts and remember their ids."""
        flat, sizes = [self.flat], []
        for p in new.to_pylist():
            ids = np.fromiter(self.search(p.decode().replace(" ", SPACE)), np.uint32)
            flat.append(ids)
            sizes.append(len(ids))
        self.parts = pa.concat_arrays([self.parts, new])
        self.flat = np.concatenate(flat)
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.array(sizes, np.int64))))

    def _rows(self, parts: pa.Array) -> np.ndarray:
        """Rows of distinct parts in what is remembered."""
        at = pc.index_in(parts, value_set=self.parts)
        if at.null_count:
            if len(self.parts) + at.null_count > MEMORY or self.parts.nbytes + parts.nbytes > MEMORY_BYTES:
                self._forget()
                self._learned(parts)
                return np.arange(len(parts))
            self._learned(parts.filter(at.is_null()))
            at = pc.index_in(parts, value_set=self.parts)
        return at.to_numpy().astype(np.int64)

    def encode_bytes(self, data: np.ndarray, at: np.ndarray, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in one buffer, as the model's library gives them, and how many each has; first: whether texts begin here, or go on."""
        size = np.diff(at)
        if self.prefixed and first:  # a space before each text that isn't empty
            full = size > 0
            data = np.insert(data, at[:-1][full], 0x20)
            at = at + np.concatenate(([0], np.cumsum(full)))
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(size), np.int64)
        kind = classes(data)
        if not self.apart:
            kind = np.where(kind == _GAP, _GAP, _OTHER)
        begins = np.zeros(n, bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _GAP)
        begins[at[:-1][at[:-1] < n]] = True
        begins = np.flatnonzero(begins)
        offsets = np.append(begins, n).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        row = self._rows(found.dictionary)[found.indices.to_numpy()]
        count = self.start[row + 1] - self.start[row]
        ends = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begins, at)]
        return self.flat[ragged(self.start[row], count)], np.diff(ends)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, counts) of a column's rows, null as empty; a text longer than SLICE is encoded in parts that begin with a space."""
        for a, b in row_ranges(column, SLICE):
            data, at = buffers(column.slice(a, b - a))
            data, at = data[at[0] : at[-1]], at - at[0]
            if len(data) <= SLICE:
                yield a, b, *self.encode_bytes(data, at)
                continue
            gap = classes(data) == _GAP
            cuts = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
            out, begin = [], 0
            while begin < len(data):
                k = int(np.searchsorted(cuts, begin + SLICE))
                end = int(cuts[k]) if k < len(cuts) else len(data)
                out.append(self.encode_bytes(data[begin:end], np.array([0, end - begin]), not begin)[0])
                begin = end
            ids = np.concatenate(out)
            yield a, b, ids, np.array([len(ids)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the model's library gives them."""
        return next(self.rows(pa.array([text], pa.string())))[2]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; byte pieces that don't make characters become U+FFFD; ids that the model lacks are an error."""
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        if len(_LOADED) > 3:
            _LOADED.clear()
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with a column of the ids of its text, by the model file at path, which executors must be able to read.

    A null or empty text has no ids; a text of any length is encoded in parts;
    repeated rows are encoded each; an empty table gives none; other columns pass through, and one with the new name is replaced.
    """
    rest = docs.drop(ids)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for a, b, flat, counts in model.rows(batch.column("text")):
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*some.columns, lists(flat.astype(np.int32), counts, pa.int32())], [*some.schema.names, ids])

    return rest.mapInArrow(f, StructType([*rest.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids have none. The inverse of encoded(), but for U+2581, which becomes a space."""
    rest = rows.drop(text)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                x = some.column(ids)
                at, flat, null = x.offsets.to_numpy(), x.values.to_numpy(), x.is_null().to_pylist()
                got = [None if null[k] else model.decode(flat[at[k] : at[k + 1]]) for k in range(len(x))]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got, pa.string())], [*some.schema.names, text])

    return rest.mapInArrow(f, StructType([*rest.schema.fields, StructField(text, StringType())]))
