"""Periodic runs of words: Crochemore's partition refinement.

Positions whose next l words agree form a class. Classes of length l + 1 follow from those
of length l: two positions stay together if the positions behind them are together. Two
neighbours of a class at distance l are a square of two times l words, and l is then its
smallest period: an occurrence between the two would be a neighbour. Squares of one period
at consecutive positions are one run.

Many texts are refined at once, as one row of words with an end of its own behind each
text. While a level leaves less than ``SHRINK`` of the positions in classes of two and
more, it is refined as a whole, by sorting; those levels together cost a constant number
of sorts of all words. From there on only the smaller parts of what was split split the
classes before them, so a position is moved at most log n times.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are refined together; a longer text goes alone.
BATCH_WORDS = 1 << 19
#: Levels are refined as a whole while they leave fewer than this share of positions.
SHRINK = 0.7

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class _Classes:
    """Classes of positions as linked lists in order of position, refined by smaller parts."""

    def __init__(self, order: np.ndarray, labels: np.ndarray, level: int):
        """order: positions by class, then position; labels: their classes."""
        at, label = order.tolist(), labels.tolist()
        self.level = level
        self.of = dict(zip(at, label, strict=True))
        self.size: dict[int, int] = defaultdict(int)
        self.head: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.prev: dict[int, int] = {}
        self.near: dict[int, list[int]] = defaultdict(list)  # by distance: who may have a neighbour there
        self.fresh = max(label, default=-1) + 1
        before = None
        for i, c in zip(at, label, strict=True):
            self.size[c] += 1
            if self.size[c] == 1:
                self.head[c] = i
            else:
                self._join(before, i)
            before = i
        # All classes split at first, those of one position too.
        single = [[i + 1] for i in at if i + 1 not in self.of]
        self.work = [list(self._members(c)) for c in self.size] + single

    def _join(self, i: int, j: int) -> None:
        self.next[i], self.prev[j] = j, i
        if j - i > self.level:
            self.near[j - i].append(i)

    def _members(self, c: int) -> Iterator[int]:
        i = self.head[c]
        while i is not None:
            yield i
            i = self.next.get(i)

    def _cut(self, c: int, part: list[int]) -> int:
        """Take ``part``, in order, out of class c; the new class."""
        new, self.fresh = self.fresh, self.fresh + 1
        for i in part:
            p, n = self.prev.pop(i, None), self.next.pop(i, None)
            if p is None:
                self.head[c] = n
                if n is not None:
                    del self.prev[n]
            elif n is None:
                del self.next[p]
            else:
                self._join(p, n)
            self.of[i] = new
        self.size[c] -= len(part)
        self.size[new], self.head[new] = len(part), part[0]
        for i, j in zip(part, part[1:]):
            self._join(i, j)
        return new

    def refine(self) -> None:
        """From classes of length ``level`` to those of one more word."""
        parts: dict[int, list[int]] = {}
        origin: dict[int, int] = {}
        for group in self.work:
            split: dict[int, list[int]] = {}
            for i in group:
                c = self.of.get(i - 1)
                if c is not None:
                    split.setdefault(c, []).append(i - 1)
            for c, part in split.items():
                if len(part) < self.size[c]:
                    new, root = self._cut(c, part), origin.get(c, c)
                    origin[new] = root
                    parts.setdefault(root, [root]).append(new)
        self.work = []
        for children in parts.values():
            children.remove(max(children, key=self.size.__getitem__))
            self.work += [list(self._members(c)) for c in children]
        self.level += 1

    def squares(self) -> list[int]:
        """Positions with a neighbour at distance ``level``."""
        return sorted({i for i in self.near.pop(self.level, ()) if self.next.get(i) == i + self.level})


def squares(codes: np.ndarray, shrink: float = SHRINK) -> Iterator[tuple[int, np.ndarray]]:
    """(period, ascending positions where a square of that smallest period starts). ``codes``
    are the words of texts, each text ended by a code that occurs nowhere else."""
    n, level, active = len(codes), 1, len(codes)
    order = np.argsort(codes, kind="stable")
    keys = codes[order]
    while True:
        same = keys[1:] == keys[:-1]
        yield level, np.sort(order[:-1][same & (np.diff(order) == level)])
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order, labels = order[many], np.cumsum(np.concatenate([[True], ~same]))[many]
        if not len(order):
            return
        if len(order) > shrink * active and level > 1:
            break
        active = len(order)
        # A position alone in its class has a label of its own.
        label = np.arange(n, dtype=np.int64) + n + 1
        label[order] = labels
        at = np.sort(order)
        keys = label[at] * (2 * n + 1) + label[at + 1]
        by = np.argsort(keys, kind="stable")
        order, keys = at[by], keys[by]
        level += 1
    classes = _Classes(order, labels, level)
    while classes.work:
        classes.refine()
        found = classes.squares()
        if found:
            yield classes.level, np.array(found, np.int64)


def runs_of(codes: np.ndarray, min_length: int, shrink: float = SHRINK) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``min_length`` words at least."""
    found = [np.empty((0, 3), np.int64)]
    for period, at in squares(codes, shrink):
        if len(at):
            edge = np.flatnonzero(np.diff(at) != 1)
            first, last = at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])]
            length = last - first + 2 * period
            long = length >= min_length
            found.append(np.stack([first[long], length[long], np.full(int(long.sum()), period)], axis=1))
    return np.concatenate(found)


def _refined(texts: list[list[bytes]], min_length: int) -> list[tuple[list[dict], list[bytes]]]:
    """For the words of each text its runs and the words that collapsing keeps."""
    codes, starts, size = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        own = [known.setdefault(w, len(known)) for w in words]
        codes.append(np.array([*own, len(known)], np.int64) + size)
        starts.append(size)
        size += len(words) + 1
    runs = runs_of(np.concatenate(codes), min_length)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], [*starts, size])
    out = []
    for i, words in enumerate(texts):
        own = runs[bounds[i] : bounds[i + 1]] - [starts[i], 0, 0]
        if len(own):
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, own[:, 0] + own[:, 2], 1)
            np.add.at(steps, own[:, 0] + own[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
        out.append(([dict(zip(("start", "length", "period"), r)) for r in own.tolist()], words))
    return out


def _find(min_length: int, schema: pa.Schema):
    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        done = _refined(texts, min_length)
        columns = [
            pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([runs for runs, _ in done], schema.field(2).type), pa.array([b" ".join(kept).decode() for _, kept in done], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D
                if texts and size + len(words) > BATCH_WORDS:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                texts.append(words)
                size += len(words) + 1
        if texts:
            yield flush(ids, texts)

    return run


def periodic_runs(docs: DataFrame, *, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words long, runs, collapsed), a row for each row of ``docs``.

    Words are split at 0x20 and 0x09-0x0D and numbered from 0. ``runs`` holds (start, length,
    period) of every stretch of at least ``min_length`` words, and two periods, that no
    neighbouring word extends, by start, then period, its smallest. ``collapsed`` is the text
    without the words that any run holds after its first period, joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows with null or
    repeated ids are rows of their own. Words differ in case. A very long text is one row
    of one task, and its time grows with n log n. An empty table gives an empty table;
    other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    named = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([
        named.schema[0], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType()),
    ])
    return named.mapInArrow(_find(min_length, to_arrow_schema(schema)), schema)
