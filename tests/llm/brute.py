"""Plain versions of the operators, and a small table of odd documents."""

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, chunk int, score double, q_w string"
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku".split()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def documents(seed=3, n=120):
    """Random texts with exact and near copies, shared passages, odd rows, and columns whose names may clash."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(rng.choice([word(), word().upper(), word() + ".\n"]) for _ in range(k))
    passage = text(70)
    texts = [text(rng.choice([1, 3, 5, 8, 60, 120, 300])) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] = texts[i // 2]
    for i in range(1, n, 7):
        w = texts[i // 2].split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    for i in range(2, n, 9):
        texts[i] = text(20) + " " + passage + " " + text(20)
    texts += ["", None, "   \n\t ", "é漢字 ﬁ ₤", "a" * 700, "ab" * 400, passage, "x " * 300, "Released under the MIT License.\nGNU General\nPublic License cc by, Apache  License", "<|endoftext|> don't '' 12½"]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s0", "s1", None][k % 5 % 3], None if t is None else len(t), "l", 1, 0.5, "w") for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[0]]


def shingles(text):
    w = words(text)
    return frozenset(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(texts, span=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def quality_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    t = list(zip(w, w[1:], w[2:]))
    n = Counter(t)
    covered = {p for i, x in enumerate(t) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
