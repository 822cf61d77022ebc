"""Vectorised word, shingle and character n-gram hashes over batches of texts.

Words are maximal runs of alphanumeric code points, compared after lower-casing
code point by code point (so character offsets stay those of the text).  Hashes
are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Code points from here on count as word characters of their own (no case).
TABLE_END = 0x30000
#: Code points handled at once, unless one text alone is longer.
CHUNK_CHARS = 1_000_000
SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLES: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (bijective, avalanching)."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _word_table() -> np.ndarray:
    """Lower-cased code point of every alphanumeric one, 0 for the others."""
    if "word" not in _TABLES:
        t = np.zeros(TABLE_END, np.uint32)
        for cp in range(TABLE_END):
            c = chr(cp)
            if c.isalnum():
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _TABLES["word"] = t
    return _TABLES["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _TABLES or len(_TABLES["pow"]) < n:
        size = max(n, CHUNK_CHARS + 1024)
        one = np.ones(1, np.uint64)
        _TABLES["pow"] = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE, np.uint64))])
        _TABLES["inv"] = np.concatenate([one, np.cumprod(np.full(size - 1, _INV, np.uint64))])
    return _TABLES["pow"], _TABLES["inv"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def folded(cps: np.ndarray) -> np.ndarray:
    """Lower-cased word characters; 0 where a code point belongs to no word."""
    table = _word_table()
    if len(cps) and int(cps.max()) >= TABLE_END:
        return np.where(cps < TABLE_END, table[np.minimum(cps, TABLE_END - 1)], cps)
    return table[cps]


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in groups of about ``limit`` characters: (first index, texts)."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield start, part


def words(texts: Sequence[str], prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Of all words in order: hash, index of the text, begin and end offset in it;
    with ``prefix``, also the hash of each word's first characters, so many."""
    cps = code_points("\n".join(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    low = folded(cps)
    n = len(low)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = low > 0
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * power[:n], out=total[1:])
    h = mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _C2)
    doc = np.searchsorted(ends, begin, side="right")
    first = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
    out = (h, doc, begin - first[doc], end - first[doc])
    if prefix:
        to = np.minimum(begin + prefix, end)
        out += (mix64((total[to] - total[begin]) * inverse[begin] + (to - begin).astype(np.uint64) * _C1),)
    return out


_MULT = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of every run of ``n`` words inside one text."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if n <= SHINGLE_WORDS:
        s = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            s += h[j:len(h) - n + 1 + j] * _MULT[j]
    else:
        power, inverse = _powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:len(h)], out=total[1:])
        s = (total[n:] - total[:-n]) * inverse[:len(h) - n + 1]
    at = np.flatnonzero(doc[:len(h) - n + 1] == doc[n - 1:])
    return mix64(s[at] + np.uint64(n)), at


def shingles(texts: Sequence[str], n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles in order: hash and index of the text.

    A text of fewer than ``n`` words but at least one has a single shingle, all
    its words; one without a word has none.
    """
    h, doc, _, _ = words(texts)
    s, at = windows(h, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(doc, few)
        extra = np.array([(h[a:a + c] * _MULT[:c]).sum(dtype=np.uint64) for a, c in zip(first, count[few], strict=True)],
                         np.uint64)
        extra = mix64(extra + count[few].astype(np.uint64))
        s, owner = np.concatenate([s, extra]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    return s, owner
