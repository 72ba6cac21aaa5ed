"""Language identification by words first, with backoff to character n-grams.

A known word is scored by its log frequency in each language. A word the
model doesn't know is scored by its character n-grams of the longest length
of which the model knows any, down to single letters. The model is fitted on
a bounded sample of labelled rows, dealt evenly to the languages, and keeps
every word and n-gram of that sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusloom.llm.common import buffers, by_arrow, ragged, row_ranges, stored

#: Labelled rows that the model is fitted on, about, and bytes of their texts, over all languages. They bound the model.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64_000_000
#: Lengths of n-grams.
LENGTHS = (4, 3, 2, 1)
#: Weight of a word that is scored by n-grams, and what is added to counts.
BACKOFF, ADDED = 0.5, 0.5
#: Bytes of text scored at once with few languages; languages from which on it is less.
SLICE, FEW = 1 << 22, 16
#: Words whose n-grams are counted together.
TOGETHER = 1 << 15
#: Languages whose sampling shares are broadcast at most; more are joined by shuffle.
BROADCAST_LANGS = 10_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
#: ASCII letters in lower case, other ASCII as spaces, other bytes as they are.
_APART = np.arange(256, dtype=np.uint8)
_APART[:0x80] = 0x20
_APART[0x61:0x7B] = np.arange(0x61, 0x7B)
_APART[0x41:0x5B] = np.arange(0x61, 0x7B)


def word_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of some rows: (row of each, code of each, distinct words, whether a row has a letter).

    Words are runs of letters in lower case; texts are cut at ASCII that isn't
    a letter first, and what holds other characters is cut and lowered by
    Python's rules then. Characters that only count as numbers make no words.
    """
    rows = len(at) - 1
    text = pa.StringArray.from_buffers(rows, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(_APART[data]))
    split = pc.ascii_split_whitespace(text)
    found = split.flatten().dictionary_encode()
    units, codes = found.dictionary, found.indices.to_numpy()
    row = np.repeat(np.arange(rows), pc.list_value_length(split).to_numpy())
    # units that are words as they stand; what others consist of
    plain = pc.and_(pc.string_is_ascii(units), pc.greater(pc.binary_length(units), 0)).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~plain)
    parts = [[w for w in _LETTERS.findall(u.lower()) if any(map(str.isalpha, w))] for u in units.take(pa.array(odd)).to_pylist()]
    kept = units.filter(pa.array(plain))
    every = pa.concat_arrays([kept, pa.array([w for p in parts for w in p], pa.string())]).dictionary_encode()
    of_part = every.indices.to_numpy()
    # of a unit: where its words are among of_part, and how many
    start, count = np.zeros(len(units), np.int64), np.ones(len(units), np.int64)
    start[plain] = np.arange(len(kept))
    count[odd] = [len(p) for p in parts]
    start[odd] = len(kept) + np.cumsum(count[odd]) - count[odd]
    if len(odd):
        row = np.repeat(row, count[codes])
        codes = of_part[ragged(start[codes], count[codes])]
    else:
        codes = of_part[start[codes]]
    return row, codes, every.dictionary, np.bincount(row, minlength=rows) > 0


def parts_of(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of some rows at once; a longer row comes in parts that are cut between words."""
    for a, b in row_ranges(column, most):
        data, at = buffers(column.slice(a, b - a))
        data, at = data[at[0] : at[-1]], at - at[0]
        if b - a > 1 or len(data) <= most:
            yield a, data, at
            continue
        gaps = np.flatnonzero(_APART[data] == 0x20)
        begin = 0
        while begin < len(data):
            k = int(np.searchsorted(gaps, begin + most))
            end = int(gaps[k]) if k < len(gaps) else len(data)
            yield a, data[begin:end], np.array([0, end - begin])
            begin = end


class _Table:
    """Sparse log counts: of item i, languages lang[at[i]:at[i + 1]] and what their counts add to the score of one not seen."""

    def __init__(self, item: np.ndarray, lang: np.ndarray, n: np.ndarray, items: int, langs: int):
        """Counts by item and language; pairs may be repeated."""
        key, inverse = np.unique(item * langs + lang, return_inverse=True)
        n = np.bincount(inverse, n, minlength=len(key))
        self.lang = (key % langs).astype(np.int32) if langs else np.zeros(0, np.int32)
        self.more = np.log((n + ADDED) / ADDED)
        self.at = np.searchsorted(key, np.arange(items + 1) * langs)
        total = np.bincount(self.lang, n, minlength=langs) + ADDED * (items + 1)
        self.none = np.log(ADDED / total)  # an item not seen, by language

    def sums(self, items: np.ndarray, into: np.ndarray, rows: int) -> np.ndarray:
        """Sums by row of the scores of items: rows x languages."""
        langs = len(self.none)
        count = self.at[items + 1] - self.at[items]
        where = ragged(self.at[items], count)
        out = np.bincount(np.repeat(into, count) * langs + self.lang[where], self.more[where], minlength=rows * langs).reshape(rows, langs)
        return out + np.bincount(into, minlength=rows)[:, None] * self.none


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of <word> of all words together, and the word of each."""
    text = "".join([f"<{w}>" for w in words])
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.repeat(np.arange(len(words)), size)


class Model:
    """Log frequencies by word and by n-gram.

    An n-gram is known by the number of its first n - 1 characters among
    n-grams of that length and its last character, so numbers are exact. Words
    are padded with < and >, but for single letters; n-grams over two words hold
    >< and are never known.
    """

    def __init__(self, langs: list[str], words: pa.Array, lang: np.ndarray, n: np.ndarray):
        """Counts n of words (repeated by language) by index of the language."""
        self.langs = langs
        found = words.dictionary_encode()
        self.words = found.dictionary
        self.known = _Table(found.indices.to_numpy().astype(np.int64), lang, n, len(self.words), len(langs))
        self.keys: dict[int, np.ndarray] = {}
        self.grams: dict[int, _Table] = {}
        size = max(1, len(langs))
        for k in sorted(LENGTHS):
            keys, langs_of, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for a in range(0, len(words), TOGETHER):
                codes, of = _padded(words.slice(a, TOGETHER).to_pylist())
                key = self._path(codes, k)
                on = np.flatnonzero((key >= 0) & (of[: len(key)] == of[k - 1 :]))
                names, back = np.unique(key[on], return_inverse=True)
                both = back * size + lang[a + of[on]]
                sums = np.bincount(both, n[a + of[on]], minlength=len(names) * size)
                some = np.flatnonzero(sums)
                keys.append(names[some // size])
                langs_of.append(some % size)
                counts.append(sums[some])
            self.keys[k], ids = np.unique(np.concatenate(keys), return_inverse=True)
            self.grams[k] = _Table(ids, np.concatenate(langs_of), np.concatenate(counts), len(self.keys[k]), len(langs))

    def _path(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Keys of the n-grams of k characters that begin at each place; -1 where the model doesn't know the first k - 1, or for a letter alone that is no letter."""
        if k == 1:
            return np.where((codes == 0x3C) | (codes == 0x3E), -1, codes)
        before = codes
        for j in range(2, k):
            before = self._at(j, self._key(before, codes, j))
        return self._key(before, codes, k)

    @staticmethod
    def _key(before: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(codes) - k + 1)
        return np.where(before[:n] >= 0, before[:n] << 21 | codes[k - 1 :], -1)

    def _at(self, k: int, key: np.ndarray) -> np.ndarray:
        """Numbers of n-grams; -1 where the model doesn't know one."""
        have = self.keys[k]
        if not len(have):
            return np.full(len(key), -1, np.int64)
        at = np.searchsorted(have, key)
        at[at == len(have)] = 0
        return np.where(have[at] == key, at, -1)

    def of_unknown(self, words: list[str]) -> np.ndarray:
        """Mean log frequency of the longest known n-grams of each word, weighed down: words x languages."""
        codes, of = _padded(words)
        ids = {1: self._at(1, self._path(codes, 1))}
        before = codes
        for k in (2, 3, 4):
            ids[k] = before = self._at(k, self._key(before, codes, k))
        out = np.zeros((len(words), len(self.langs)))
        open_ = np.ones(len(words), bool)
        for k in LENGTHS:
            on = np.flatnonzero((ids[k] >= 0) & open_[of[: len(ids[k])]])
            number = np.bincount(of[on], minlength=len(words))
            some = number > 0
            place = np.cumsum(some) - 1
            sums = self.grams[k].sums(ids[k][on], place[of[on]], int(some.sum()))
            out[some] = BACKOFF * sums / number[some][:, None]
            open_ &= ~some
        return out

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Scores of distinct words: words x languages."""
        at = pc.index_in(words, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(words), len(self.langs)))
        out[known] = self.known.sums(at.drop_null().to_numpy().astype(np.int64), np.arange(int(known.sum())), int(known.sum()))
        out[~known] = self.of_unknown(words.filter(pa.array(~known)).to_pylist())
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """For each text its language and that one's posterior under even priors; of languages with one score the first by name."""
        langs = len(self.langs)
        total, lettered = np.zeros((len(texts), langs)), np.zeros(len(texts), bool)
        if langs:
            for first, data, at in parts_of(texts, SLICE * FEW // max(FEW, langs)):
                row, codes, words, found = word_codes(data, at)
                scores = self.of_words(words)
                n = len(at) - 1
                for k in range(langs):
                    total[first : first + n, k] += np.bincount(row, scores[codes, k], minlength=n)
                lettered[first : first + n] |= found
        if not lettered.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        share = 1 / np.exp(np.clip(total - total.max(1)[:, None], -700, 0)).sum(1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, share, 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled rows by language; sums within slices."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        for first, data, at in parts_of(batch.column("text"), SLICE):
            row, codes, words, _ = word_codes(data, at)
            key, n = np.unique(lang.indices.to_numpy()[first : first + len(at) - 1].astype(np.int64)[row] * len(words) + codes, return_counts=True)
            size = max(1, len(words))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // size)), words.take(pa.array(key % size)), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model from labelled (doc_id, text, lang); lang isn't null.

    About `rows` rows with about `size` bytes are used, chosen by a hash of
    doc_id so that each language gets its even share (all rows of a language
    with fewer). The words of these rows and their counts come to the driver;
    both bounds hold for them, and for the model that is broadcast.
    """
    spark = labelled.sparkSession
    have = stored(labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")))
    number = have.count()
    if not number:
        return Model([], pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    share = F.least(F.lit(rows / number) / F.col("rows"), F.lit(size / number) / F.greatest("size", F.lit(1)))
    shares = have.select("lang", share.alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = labelled.join(F.broadcast(shares) if number <= BROADCAST_LANGS else shares, "lang").where(draw < F.col("share")).select("lang", "text")
    sums = by_arrow(sample, _counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    t = stored(sums).toArrow().combine_chunks()
    langs = sorted(set(t.column("lang").unique().to_pylist()))
    of = pc.index_in(t.column("lang"), value_set=pa.array(langs, pa.string())).combine_chunks().to_numpy().astype(np.int64) if langs else np.zeros(0, np.int64)
    word = t.column("word").combine_chunks() if t.num_rows else pa.array([], pa.string())
    return Model(langs, word.cast(pa.string()), of, t.column("n").to_numpy())


def held_out(doc_id: Column | str) -> Column:
    """Rows that a model must not learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from docs (doc_id, text, lang) that aren't held out and have a lang.

    score is the posterior of lang_pred under even priors; of languages with
    one posterior the first by name is taken. A null text, or one without a
    letter, or any text when there is nothing to learn from, is UNKNOWN with
    score 0. A text of any length is scored in slices. Repeated rows are scored
    each; an empty table gives none; other columns pass through, and columns
    with the new names are replaced.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where(~held_out("doc_id") & F.col("lang").isNotNull())
    # bounded by SAMPLE_ROWS and SAMPLE_BYTES
    model = spark.sparkContext.broadcast(fit(known))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = model.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    rest = docs.drop("held_out", "lang_pred", "score")
    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rest.mapInArrow(f, schema).withColumn("held_out", held_out("doc_id"))


def language_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that can have a language, with the columns of docs: a null text or one without letters goes, whatever is predicted.

    Where there is nothing to learn a language from, all texts with letters
    stay. Repeated rows stay each; an empty table gives none; columns keep their
    values, whatever their names.
    """
    names = {"held_out", "lang_pred", "score"}
    clash = {c: f"_kept_{c}" for c in docs.columns if c in names}
    found = languages(docs.withColumnsRenamed(clash))
    # the score is above 0 wherever a model found a letter
    found = found.where((F.col("score") > 0) | F.col("text").rlike(r"\p{L}"))
    return found.drop(*names).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
