"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are taken together up to so many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True, places: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of ``texts`` (split at 0x20 and 0x09-0x0D), one text after another,
    and the bounds of each text's words, one more than texts. ``lower`` takes A-Z as a-z;
    ``places`` adds where words start and the joined bytes."""
    whole = b"\n".join(texts) + b"\n"
    joined = np.frombuffer(whole.lower() if lower else whole, np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    space = _SPACE[joined]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(joined))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)])])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    found = hashes, np.searchsorted(starts, bounds)
    return (*found, starts, joined) if places else found


def word_total(texts: list[bytes]) -> int:
    """How many words ``texts`` hold, without hashing them."""
    space = _SPACE[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
    return int(np.count_nonzero(space[1:] & ~space[:-1]))


def shingles(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; fewer words
    make one shingle, no words none."""
    for a, b in chunks(texts):
        words, bounds = word_hashes(texts[a:b])
        factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width if len(runs) else 0):
            runs += words[j : j + len(runs)] * factors[j]
        runs = mix(runs)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                yield mix((words[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)
