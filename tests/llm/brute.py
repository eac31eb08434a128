"""Plain forms of what the text operators must return, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def encode(name, texts, end):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(name)))
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [np.array([*x.ids, end], dtype="<u4") for x in found]


def crc(ids):
    return zlib.crc32(ids.tobytes())


def shingles(text):
    w = words(text.translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(docs, percent=85):
    """Smallest id of each id's group; docs: (id, text), ids may repeat."""
    sets = [(i, shingles(t or "")) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


def kept_bytes(texts, length=200):
    """(bytes, removed, runs, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), runs, kept))
    return out


def kept_lines(docs, least=20, docs_least=3):
    """(lines, dropped, text) of each (id, text)."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [
            line for line in lines
            if i is None or len(key(line)) < least or len(holders[key(line)]) < docs_least
            or i == max(holders[key(line)])
        ]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    twice = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def personal(text):
    """kind:start:end of all base spans."""
    out = []
    for kind, pattern in _PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and _luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, repeated, len(inside)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
