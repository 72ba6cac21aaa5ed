"""Which legacy encoding bytes are in, by the pairs of bytes that are usual in each; fitted on a table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.decode import LEGACY, non_ascii

#: Non-ASCII bytes below which no encoding is named.
EVIDENCE = 32
#: By how much a pair must be likelier on average, in natural logarithms, than in any other encoding that could be meant.
MARGIN = 0.5
PAIRS = 1 << 16


def pairs(data: bytes) -> np.ndarray:
    """Neighbouring bytes, of which one at least isn't ASCII, as numbers below PAIRS."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    both = x[:-1] << 8 | x[1:]
    return both[(x[:-1] | x[1:]) > 127]


class Nominator:
    """Log probabilities of pairs by encoding; as large as PAIRS numbers for each, whatever it was fitted on."""

    def __init__(self, counts: dict[str, np.ndarray]):
        #: An encoding without any text is never named.
        self.logs = {label: np.log((n + 0.05) / (n.sum() + 0.05 * PAIRS)).astype(np.float32) for label, n in counts.items() if n.any()}

    def nominate(self, data: bytes, clean: tuple[str, ...] = tuple(LEGACY)) -> str | None:
        """The label of the likeliest encoding if it is one of `clean` and no other is about as likely; None with less than EVIDENCE."""
        if non_ascii(data) < EVIDENCE:
            return None
        found = pairs(data)
        scores = sorted(((float(self.logs[label][found].mean()), label) for label in clean if label in self.logs), reverse=True)
        if not scores or len(scores) > 1 and scores[0][0] - scores[1][0] < MARGIN:
            return None
        return scores[0][1]


def fitted(texts: DataFrame, column: str = "text") -> Nominator:
    """A nominator from texts in the languages that are to be told apart.

    A text counts for each encoding that can hold all of it, but only its pairs
    that aren't ASCII. Tasks add up pairs; the driver gets at most PAIRS counts for
    each encoding. Null texts and those in ASCII count for none.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {label: np.zeros(PAIRS, np.int64) for label in LEGACY}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text is None or text.isascii():
                    continue
                for label, codec in LEGACY.items():
                    try:
                        data = text.encode(codec)
                    except UnicodeEncodeError:
                        continue
                    counts[label] += np.bincount(pairs(data), minlength=PAIRS)
        for label, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], ["label", "pair", "n"])

    rows = texts.select(column).mapInArrow(f, "label string, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).toArrow()
    counts = {label: np.zeros(PAIRS) for label in LEGACY}
    for label, pair, n in zip(*(rows.column(c).to_pylist() for c in ("label", "pair", "n"))):
        counts[label][pair] = n
    return Nominator(counts)
