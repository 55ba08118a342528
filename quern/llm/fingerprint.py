"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (lines, long ones cut after words whose hash divides by eight, so
that cuts follow the content) become digests, and each digest goes into one cell of each
third of a table: a count, a sum of digests and a sum of check values. The tables of two
versions subtract cell by cell; peeling cells that hold a single digest recovers which
paragraphs differ.

A fingerprint is the smallest table, of 8 cells a third or twice as many again and again,
that gives back all of its own digests. Folding its halves onto each other gives the
smaller ones. Two fingerprints are compared at the smallest size that can hold their
difference, twice as large where peeling gets stuck, up to the smaller one's size; beyond
it each gives back its own digests. So likeness follows from two fingerprints alone.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.hashing import CHUNK_BYTES, mix, word_hashes

#: Cells of a third of the smallest table.
THIRD = 8
#: A paragraph is cut after a word whose hash divides by this.
CUT = 8
_ONE = np.uint64(1)


def paragraph_digests(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct digests of its paragraphs; white space inside a
    paragraph does not count, case does."""
    out: list[np.ndarray] = []
    for a, b in _chunks(texts):
        raw = [t.encode() for t in texts[a:b]]
        words, bounds, starts, joined = word_hashes(raw, lower=False, places=True)
        if not len(words):
            out += [np.empty(0, np.uint64)] * len(raw)
            continue
        newlines = np.concatenate([[0], np.cumsum(joined == 10)])[starts]
        first = np.concatenate([[True], (words[:-1] % np.uint64(CUT) == 0) | (np.diff(newlines) > 0)])
        at = np.flatnonzero(first)
        place = np.arange(len(words)) - at[np.cumsum(first) - 1]
        factors = mix(np.arange(1, place.max() + 2, dtype=np.uint64)) | _ONE
        digests = mix(np.add.reduceat(words * factors[place], at))
        ends = np.searchsorted(at, bounds)
        out += [np.unique(digests[ends[i] : ends[i + 1]]) for i in range(len(raw))]
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _cells(digests: np.ndarray, third: int) -> list[np.ndarray]:
    return [
        (mix(digests + np.uint64(0xA5A5 * (j + 1))) % np.uint64(third)).astype(np.int64) + j * third for j in range(3)
    ]


def _check(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ np.uint64(0xC0FFEE)) >> np.uint64(32)


def tables(sets: list[np.ndarray], third: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums (modulo 2^64), a row of 3 * ``third`` cells a set."""
    width = 3 * third
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * width
    digests = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    count = np.zeros(len(sets) * width, np.int64)
    total, check = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
    own = _check(digests)
    for cell in _cells(digests, third):
        np.add.at(count, owner + cell, 1)
        np.add.at(total, owner + cell, digests)
        np.add.at(check, owner + cell, own)
    shape = (len(sets), width)
    return count.reshape(shape), total.reshape(shape), check.reshape(shape)


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests that subtracted tables hold: (solved per row, row, digest, sign +1 or -1)."""
    n, width = count.shape
    third = width // 3
    count, total, check = count.ravel().copy(), total.ravel().copy(), check.ravel().copy()
    rows, digests, signs = [], [], []
    at = np.flatnonzero(np.abs(count) == 1)
    while len(at):
        sign = count[at]
        digest = np.where(sign > 0, total[at], np.uint64(0) - total[at])
        pure = (np.abs(sign) == 1) & (np.where(sign > 0, check[at], np.uint64(0) - check[at]) & _CHECK_BITS == _check(digest))
        row, digest, sign = at[pure] // width, digest[pure], sign[pure]
        order = np.lexsort((digest, row))
        row, digest, sign = row[order], digest[order], sign[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
        row, digest, sign = row[new], digest[new], sign[new]
        if not len(row):
            break
        rows.append(row), digests.append(digest), signs.append(sign)
        own = _check(digest)
        touched = [row * width + cell for cell in _cells(digest, third)]
        for cell in touched:
            np.subtract.at(count, cell, sign)
            np.subtract.at(total, cell, np.where(sign > 0, digest, np.uint64(0) - digest))
            np.subtract.at(check, cell, np.where(sign > 0, own, np.uint64(0) - own))
        at = np.unique(np.concatenate(touched))
    left = (count.reshape(n, width) != 0).any(1) | (total.reshape(n, width) != 0).any(1) | (check.reshape(n, width) & _CHECK_BITS != 0).any(1)
    none = np.empty(0, np.int64)
    return ~left, np.concatenate(rows or [none]), np.concatenate(digests or [none.astype(np.uint64)]), np.concatenate(signs or [none])


Table = tuple[np.ndarray, np.ndarray, np.ndarray]
_CELL = np.dtype([("n", "<i4"), ("s", "<u8"), ("c", "<u4")])
_CHECK_BITS = np.uint64(0xFFFFFFFF)


def own_tables(sets: list[np.ndarray]) -> tuple[list[Table], list[np.ndarray]]:
    """For each set the smallest table that gives all of it back, found by trying, twice as
    large after each failure; and the digests that it gave back."""
    third = np.full(len(sets), THIRD)
    sizes = np.array([len(s) for s in sets], np.int64)
    while (small := 3 * third < sizes).any():
        third[small] *= 2
    out: list[Table] = [None] * len(sets)  # type: ignore[list-item]
    back: list[np.ndarray] = [None] * len(sets)  # type: ignore[list-item]
    open_ = np.arange(len(sets))
    while len(open_):
        left = []
        for size, now in _groups(third, open_):
            made = tables([sets[i] for i in now], size)
            solved, row, digests, _ = peel(*made)
            for k, (i, found) in enumerate(zip(now, _by_row(row, digests, len(now)), strict=True)):
                out[i], back[i] = (made[0][k], made[1][k], made[2][k]), found
            stuck = now[~solved]
            third[stuck] *= 2
            left.append(stuck)
        open_ = np.concatenate(left)
    return out, back


def _groups(third: np.ndarray, open_: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(int(size), open_[third[open_] == size]) for size in np.unique(third[open_])]


def _by_row(row: np.ndarray, digests: np.ndarray, rows: int) -> list[np.ndarray]:
    order = np.argsort(row, kind="stable")
    return np.split(digests[order], np.searchsorted(row[order], np.arange(1, rows)))


def recover(made: list[Table]) -> list[np.ndarray]:
    """All digests of each of the tables that :func:`own_tables` made."""
    out: list[np.ndarray] = [None] * len(made)  # type: ignore[list-item]
    sizes = np.array([len(t[0]) for t in made], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        _, row, digests, _ = peel(*(np.stack(c) for c in zip(*(made[i] for i in at), strict=True)))
        for i, found in zip(at, _by_row(row, digests, len(at)), strict=True):
            out[i] = found
    return out


def fold(table: Table, third: int) -> Table:
    """The table that the same digests make with fewer cells a third."""
    return tuple(x.reshape(3, -1, third).sum(axis=1, dtype=x.dtype).ravel() for x in table)  # type: ignore[return-value]


def differing(a: list[Table], b: list[Table], held: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> np.ndarray:
    """For each pair of tables how many digests only one of the two has. ``held``: what the
    tables give back, where it is known."""
    out = np.zeros(len(a), np.int64)
    own = np.array([[len(x[0]) // 3, len(y[0]) // 3] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2).min(axis=1)
    # A difference of counts is a known part of the difference: no smaller table can be peeled.
    counts = [np.array([int(t[0].sum()) // 3 for t in side], np.int64) for side in (a, b)]
    third = np.full(len(a), THIRD)
    while (small := (3 * third < np.abs(counts[0] - counts[1])) & (third < own)).any():
        third[small] *= 2
    open_, beyond = np.arange(len(a)), []
    while len(open_):
        left = []
        for size, now in _groups(third, open_):
            x, y = ([np.stack(c) for c in zip(*(fold(side[i], size) for i in now), strict=True)] for side in (a, b))
            solved, row, *_ = peel(*(p - q for p, q in zip(x, y, strict=True)))
            count = np.bincount(row, minlength=len(now))
            out[now[solved]] = count[solved]
            stuck = now[~solved]
            beyond += stuck[third[stuck] >= own[stuck]].tolist()
            stuck = stuck[third[stuck] < own[stuck]]
            third[stuck] *= 2
            left.append(stuck)
        open_ = np.concatenate(left)
    if beyond:  # both give back all they hold
        one, two = ([side[i] for i in beyond] for side in held) if held else (recover([side[i] for i in beyond]) for side in (a, b))
        every = np.concatenate([*one, *two])
        row = np.concatenate([np.repeat(beyond, [len(s) for s in side]) for side in (one, two)])
        order = np.lexsort((every, row))
        every, row = every[order], row[order]
        same = (every[1:] == every[:-1]) & (row[1:] == row[:-1])
        total = np.bincount(row, minlength=len(a))
        out[beyond] = (total - 2 * np.bincount(row[1:][same], minlength=len(a)))[beyond]
    return out


def to_text(table: Table) -> str:
    cells = np.zeros(len(table[0]), _CELL)
    cells["n"], cells["s"], cells["c"] = table[0], table[1], table[2] & _CHECK_BITS
    return base64.b64encode(cells.tobytes()).decode()


def from_text(fingerprint: str) -> Table:
    cells = np.frombuffer(base64.b64decode(fingerprint), _CELL)
    return cells["n"].astype(np.int64), cells["s"].astype(np.uint64), cells["c"].astype(np.uint64)


def likenesses(a: list[Table], b: list[Table], held: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> np.ndarray:
    """1 - differing / all digests of both, so 0 to 1; two tables without a digest are alike."""
    total = np.array([(int(x[0].sum()) + int(y[0].sum())) // 3 for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(total == 0, 1.0, 1 - differing(a, b, held) / np.maximum(total, 1))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are."""
    return float(likenesses([from_text(a)], [from_text(b)])[0])


def fingerprint_versions(df: DataFrame, versions: dict[str, str], likeness: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of ``df`` without the texts named in ``versions``, plus fingerprints and likenesses.

    versions: text column -> name of its fingerprint column ("" for none). likeness: new
    column -> two text columns, whose fingerprints give 1 - differing / all digests (of both,
    so 0 to 1); two texts without a paragraph are alike (1.0). Null texts count as empty.
    Equal texts have equal fingerprints. Rows are independent, repeated ones too. A very
    long text is one table of one task; a fingerprint gives back every digest of its text,
    so it grows with the text. An empty table gives an empty table. Columns of ``df`` with a
    name of a result are replaced.
    """
    made = [*filter(None, versions.values()), *likeness]
    df = df.drop(*(c for c in made if c not in versions))
    plain = [c for c in df.columns if c not in versions]
    fields = [df.schema[c] for c in plain]
    fields += [T.StructField(c, T.StringType()) for c in versions.values() if c]
    fields += [T.StructField(c, T.DoubleType()) for c in likeness]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                index: dict[str, int] = {}
                where = {
                    c: [index.setdefault(t or "", len(index)) for t in batch.column(c).to_pylist()] for c in versions
                }
                made_, back = own_tables(paragraph_digests(list(index)))
                prints = [to_text(t) for t in made_]
                out = [batch.column(c) for c in plain]
                out += [pa.array([prints[i] for i in where[c]], pa.string()) for c in versions if versions[c]]
                for a, b in likeness.values():
                    x, y = ([made_[i] for i in where[c]] for c in (a, b))
                    out.append(pa.array(likenesses(x, y, ([back[i] for i in where[a]], [back[i] for i in where[b]]))))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


#: Rows of a range of ids, ranges at most, and rows a range that the cuts are drawn from:
#: the driver and each task hold RANGES cuts and the driver draws RANGES * DRAWN ids, however
#: many rows there are.
RANGE_ROWS, RANGES, DRAWN = 10_000, 20_000, 20


def _sortable(ids: Column, id_type: T.DataType) -> Column:
    """Ids as bytes that sort as the ids do."""
    if isinstance(id_type, T.StringType):
        return F.encode(ids, "utf-8")
    return F.to_binary(F.lpad(F.hex(ids.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("hex"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", into: str = "next_text") -> DataFrame:
    """``docs`` plus the text of the next row in ascending order of (id, text); the last row's
    next is the first. Ids are whole numbers or strings (by code point).

    Rows go to ranges of ids, one exchange of the texts; the first row of each range also
    goes to the range before it. Cuts between ranges come from a sample of ids, which moves
    no result. Null ids come last. Rows of one id, and of none, share a range. One row is
    its own next. A null text is a null next. An empty table gives an empty table. A column
    of ``docs`` named ``into`` is replaced; others may have any name, but for those that
    begin with ``_nx``.
    """
    docs = docs.drop(into)
    key = _sortable(F.col(id_col), docs.schema[id_col].dataType)
    rows = docs.count()
    ranges = max(1, min(RANGES, -(-rows // RANGE_ROWS)))
    share = min(1.0, 2.0 * DRAWN * ranges / max(rows, 1))
    drawn = sorted(bytes(r[0]) for r in docs.select(key.alias("k")).filter("k is not null").sample(share, 7).limit(4 * DRAWN * RANGES).collect())
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)} if drawn else [])

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([len(cuts) if k is None else bisect_right(cuts, bytes(k)) for k in keys], dtype="int32")

    ranged = docs.withColumns({"_nx_k": key, "_nx_b": range_of(key)})
    # One row a range: its first key, and the range that needs this row too.
    firsts = sorted((r["_nx_b"], None if r["k"] is None else bytes(r["k"])) for r in ranged.groupBy("_nx_b").agg(F.min("_nx_k").alias("k")).collect())
    first = {b: (k, firsts[i - 1][0]) for i, (b, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, held: pd.Series) -> pd.Series:
        def of(k: bytes | None, b: int) -> list[int]:
            start, guest_of = first[b]
            return [b, guest_of] if (None if k is None else bytes(k)) == start else [b]

        return pd.Series([of(k, b) for k, b in zip(keys, held, strict=True)])

    order = Window.partitionBy("_nx_to").orderBy("_nx_guest", F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_first())
    return (
        ranged.select(*docs.columns, F.posexplode(places("_nx_k", "_nx_b")).alias("_nx_guest", "_nx_to"))
        .repartitionById(len(cuts) + 1, "_nx_to")
        .withColumn(into, F.lead(text_col).over(order))
        .filter("_nx_guest = 0")
        .drop("_nx_to", "_nx_guest")
    )
