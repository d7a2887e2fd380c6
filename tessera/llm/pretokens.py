"""Vectorised pre-tokenisation shared by the byte-level BPE and the token-count operators.

The split is that of ``public_tokenizers.PATTERN``: contractions, then runs of letters, of
numbers and of other signs, each with an optional space in front, then white space whose last
character is left to the token that follows.  A pattern of that kind only needs the class of
each code point and where the runs of one class begin, so a batch is cut with a few NumPy passes
instead of one regex match per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: What may follow an apostrophe in a contraction of PATTERN.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that one NumPy pass takes; bounds memory, longer texts make one pass each.
CHUNK = 1 << 20

_classes: np.ndarray | None = None
_powers: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15


def classes() -> np.ndarray:
    """The class of every code point, by the ``regex`` module's own properties."""
    global _classes
    if _classes is None:
        import regex

        table = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            found = "".join(regex.findall(pattern + "+", every))
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _classes = table
    return _classes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for b in (_BASE, inverse):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens begin in code points; ``first`` marks the places where a text begins."""
    n = len(points)
    kind = classes()[points]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= first
    run = np.flatnonzero(new)
    space = kind[run] == SPACE
    after = np.append(run[1:], n)
    at_end = np.append(first[run[1:]], True)  # nothing follows this run in its text
    split = space & ~at_end
    last = after[split] - 1
    out = new.copy()
    out[last] = True  # the last white space character of a run stands apart...
    joined = last[points[last] == 0x20]
    out[joined + 1] = False  # ... and a space goes with the token that follows
    quote = run[(after - run == 1) & (points[run] == 0x27) & ~at_end]
    quote = quote[out[quote] & (kind[np.minimum(quote + 1, n - 1)] == LETTER)]
    if len(quote):
        ends = np.append(run, n)
        end = ends[np.searchsorted(ends, quote + 1, side="right")]
        a, b = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        size = np.zeros(len(quote), np.int64)
        for tail in sorted(CONTRACTIONS, key=len):
            hit = (a == ord(tail[0])) & (end - quote - 1 >= len(tail))
            if len(tail) == 2:
                hit &= b == ord(tail[1])
            size = np.where(hit & (size == 0), len(tail), size)
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        out[quote + 1] = False
        rest = quote + 1 + size
        out[rest[rest < end]] = True
    return np.flatnonzero(out)


def pieces(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """For groups of whole texts: (first text, end, token bounds of each, code of each token, distinct tokens).

    Bounds index the codes; codes index the distinct tokens.  Empty texts have no tokens.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        joined = "".join(texts[at:end])
        lengths = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if not joined:
            yield at, end, np.zeros(end - at + 1, np.int64), np.zeros(0, np.int64), []
        else:
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.zeros(len(points) + 1, bool)
            first[begins] = True
            token = starts(points, first[:-1])
            up, down = powers(len(points) + 1)
            sums = np.empty(len(points) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            stop = np.append(token[1:], len(points))
            codes = mix((sums[stop] - sums[token]) * down[token]) ^ (stop - token).astype(np.uint64)
            _, which, inverse = np.unique(codes, return_index=True, return_inverse=True)
            words = [joined[a:b] for a, b in zip(token[which].tolist(), stop[which].tolist(), strict=True)]
            yield at, end, np.searchsorted(token, begins), inverse, words
        at = end
