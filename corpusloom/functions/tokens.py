"""What a text costs in tokens, whole or as it grows."""

from __future__ import annotations

import base64
from collections.abc import Iterator

#: Pieces whose costs a counter remembers at most; beyond that it forgets all and begins anew.
REMEMBERED = 1 << 18


class TokenCounter:
    """Tokens of a text by a rank file of a byte-pair vocabulary and the pattern of its pretokens; without one, UTF-8 bytes, which are never fewer.

    Merges never cross pretokens, so costs add up over them, and one that comes
    again is looked up.
    """

    def __init__(self, ranks_path: str | None = None, pattern: str | None = None, ranks: bytes | None = None):
        """ranks: the content of a rank file, instead of its place."""
        self.exact = ranks_path is not None or ranks is not None
        self.pattern = pattern
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = f.read()
        self.ranks = ranks
        self._made()

    def _made(self) -> None:
        self._encode, self._split, self._known = None, None, {}
        if self.exact:
            import regex
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}
            self._encode = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self._split = regex.compile(self.pattern).findall

    def __reduce__(self):
        return TokenCounter, (None, self.pattern, self.ranks)

    def __call__(self, text: str) -> int:
        return len(self._encode(text)) if self._encode else len(text.encode())

    def pieces(self, text: str) -> list[str]:
        """The pretokens of a text, of which only the last may change when it goes on; where bytes are counted, none may."""
        return self._split(text) if self._split else [text, ""]

    def piece(self, piece: str) -> int:
        """The cost of one pretoken."""
        n = self._known.get(piece)
        if n is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            n = self._known[piece] = self(piece)
        return n


class PrefixCounter:
    """The exact cost of a text that grows: all its pretokens but the last are settled once."""

    def __init__(self, counter: TokenCounter):
        self.counter, self.settled, self.open = counter, 0, ""

    def push(self, text: str) -> PrefixCounter:
        *done, last = self.counter.pieces(self.open + text) or [""]
        if done:
            self.settled += sum(map(self.counter.piece, done))
        self.open = last
        return self

    def total(self, tail: str = "") -> int:
        """The cost of all so far, as if tail followed."""
        if not tail:
            return self.settled + (self.counter.piece(self.open) if self.open else 0)
        return self.settled + self.counter(self.open + tail)


def line_totals(text: str, counter: TokenCounter) -> Iterator[int]:
    """For each line of a text the cost of all up to its end, with its line feed; an empty last line is none.

    What is settled is never looked at again; a run of n empty lines is one
    pretoken and costs n * n / 2 steps.
    """
    so_far = PrefixCounter(counter)
    lines = text.split("\n")
    for line in lines[:-1]:
        yield so_far.push(line + "\n").total()
    if lines[-1]:
        yield so_far.push(lines[-1]).total()
