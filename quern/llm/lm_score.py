"""Language-model scores: stupid backoff over n-gram counts of the whole corpus.

Documents are packed into chunks of bounded size. For n = 1, 2, .. a chunk is exploded to its
distinct n-grams (hash, occurrences, documents), a row each; rows are partitioned by hash,
where a window counts each n-gram over the corpus and joins the count to its rows in one
exchange; n-grams of too few documents go, and the others are gathered by chunk, as places
among the chunk's own n-grams, and chunks add up the scores of their documents. An n-gram
can be in enough documents only if the two shorter ones in it are, so from n = 3 on only
such n-grams are exploded. Every n-gram is a row of its own, and rows are no more than words times
``order``: work grows with the corpus. The most frequent n-gram has a row a chunk.

n-grams are named by 64-bit hashes. With 10^9 distinct ones, two of them share a hash
with a chance of 3 in 100, and 10^12 have about 27,000 such pairs, too few to move a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.common import materialize, passing, shuffles_dropped
from quern.llm.hashing import mix, word_hashes, word_total

#: UTF-8 bytes of texts in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: From n = 2 on, n-grams are counted in so many rounds, by hash, so that only the rows of one
#: round are on disk at once.
ROUNDS = 2
#: n-grams in fewer documents count as unseen: what only one document holds says nothing about it.
MIN_DOCS = 2


def _pack(seq: int, ids: list, texts: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    from pyspark import TaskContext

    lengths = np.array([len(t) for t in texts], np.int64)
    chunk = (TaskContext.get().partitionId() << 32) + seq
    blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
    row = {"chunk": chunk, "ids": ids, "lengths": lengths.tolist(), "blob": blob, "bytes": int(lengths.sum()), "words": word_total(texts)}
    return pa.RecordBatch.from_pylist([row], schema)


def _chunks(schema: pa.Schema, chunk_bytes: int):
    """Rows (id, text) to packed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size, ids, texts = 0, 0, [], []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                if ids and size + len(raw) > chunk_bytes:
                    yield _pack(seq, ids, texts, schema)
                    seq, size, ids, texts = seq + 1, 0, [], []
                ids.append(i), texts.append(raw)
                size += len(raw) + 16
        if ids:
            yield _pack(seq, ids, texts, schema)

    return run


def _unpack(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(lengths)
    return [raw[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Bounds of the texts' words, and for n = 1 .. order the hashes of the n words that
    end at each word and whether that many lie in one text."""
    words, bounds = word_hashes(texts)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(len(words)) - start
    out, run = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        factor = mix(np.array([n], np.uint64))[0] | np.uint64(1)
        run = run.copy()
        run[n - 1 :] += words[: max(0, len(words) - n + 1)] * factor
        out.append((mix(run + np.uint64(n)), place >= n - 1))
    return bounds, out


_GRAMS = "chunk long, at int, gram long, n long, d long"


def _places(hashes: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words at which an n-gram ends (``ok``) in order of its hash, the sorted distinct hashes,
    and for each of those words the place of its hash among them."""
    at = np.flatnonzero(ok)
    at = at[np.argsort(hashes[at], kind="stable")]  # words of an n-gram stay in order, and so do texts
    found = hashes[at]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return at, found[new], np.cumsum(new, dtype=np.int32) - 1


def _rows(chunk: int, hashes: np.ndarray, ok: np.ndarray, bounds: np.ndarray, part: int, parts: int) -> pa.RecordBatch:
    """Rows of _GRAMS: the place of each distinct hash of a round among all of the chunk's, the
    hash, how often it occurs and in how many texts."""
    at, distinct, place = _places(hashes, ok)
    docs = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))[at]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    number = np.diff(np.append(first, len(at)))
    other = np.ones(len(at), np.int64)
    other[1:] = (place[1:] != place[:-1]) | (docs[1:] != docs[:-1])
    texts = np.add.reduceat(other, first) if len(first) else number
    mine = np.flatnonzero(distinct % np.uint64(parts) == part)
    columns = [np.full(len(mine), chunk, np.int64), mine.astype(np.int32), distinct[mine].view(np.int64), number[mine].astype(np.int64), texts[mine].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "at", "gram", "n", "d"])


def _levels(grams: list[tuple[np.ndarray, np.ndarray]], told: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n that ``told`` counts, the count of the n-gram at each word (0: too few documents
    hold it); and at which words the next longer n-gram can be in enough documents."""
    sizes = told["size"].to_numpy()
    out: list[np.ndarray] = []
    ok = grams[0][1]
    for n in range(1, (int(sizes.max()) if len(sizes) else 0) + 1):
        at, distinct, place = _places(grams[n - 1][0], ok)
        by_place = np.zeros(len(distinct), np.int64)
        for i in np.flatnonzero(sizes == n):  # a row a round
            by_place[told["at"][i].values.to_numpy()] = told["c"][i].values.to_numpy()
        count = np.zeros(len(ok), np.int64)
        count[at] = by_place[place]
        out.append(count)
        if n < len(grams):
            ok = _longer(grams[n][1], count, n + 1)
    return out, ok


def _longer(ok: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """At which words the n-grams that are exploded end: pairs all, longer ones where both shorter
    n-grams count."""
    if n == 2:
        return ok
    held = count > 0
    return ok & held & np.concatenate([[False], held[:-1]])[: len(held)]


def _explode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds, [(hashes, ok)] = ngrams(_unpack(row["blob"], row["lengths"]), 1)
            yield _rows(row["chunk"], hashes, ok, bounds, 0, 1)


def _explode_pairs(part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds, grams = ngrams(_unpack(row["blob"], row["lengths"]), 2)
                yield _rows(row["chunk"], *grams[1], bounds, part, parts)

    return run


def _explode(n: int, part: int, parts: int):
    """The n-grams of a chunk, those of one round, whose two shorter n-grams ``told`` counts."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        out = [_rows(0, np.empty(0, np.uint64), np.empty(0, bool), np.zeros(1, np.int64), 0, 1)]
        for row in chunks.to_pylist():
            bounds, grams = ngrams(_unpack(row["blob"], row["lengths"]), n)
            counts, ok = _levels(grams, told)
            if len(counts) == n - 1:  # else no n-gram that short is frequent here
                out.append(_rows(row["chunk"], grams[n - 1][0], ok, bounds, part, parts))
        return pa.Table.from_batches(out[1:] or out)

    return run


def _score(order: int, alpha: float, words: int, schema: pa.Schema):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            bounds, grams = ngrams(_unpack(row["blob"], row["lengths"]), order)
            of, _ = _levels(grams, told)
            of += [np.zeros(bounds[-1], np.int64)] * (order - len(of))
            value = np.full(bounds[-1], -log(words or 1))  # a word of no other document: one in all words
            backed = np.minimum(np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds)), order - 1) + 1
            level = np.zeros(bounds[-1], np.int64)
            for n in range(1, order + 1):
                seen = of[n - 1] > 0
                above = np.roll(of[n - 2], 1) if n > 1 else np.full(len(seen), words)
                value[seen] = np.log(of[n - 1][seen] / np.maximum(above[seen], 1))
                level[seen] = n
            micro = np.floor((value + (backed - level) * log(alpha)) * 1e6 + 0.5).astype(np.int64)
            sums = np.diff(np.concatenate([[0], np.cumsum(micro)])[bounds])
            top = np.diff(np.concatenate([[0], np.cumsum(level == order)])[bounds])
            out.append(
                pa.table(
                    [pa.array(row["ids"], schema.field(0).type), pa.array(np.diff(bounds).astype(np.int64)), pa.array(top), pa.array(sums)],
                    schema=schema,
                )
            )
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score_documents(
    docs: DataFrame,
    *,
    order: int = 2,
    alpha: float = 0.4,
    min_docs: int = MIN_DOCS,
    chunk_bytes: int = CHUNK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(``id_col``, n_words, n_top, log_micro): a row for each row of ``docs``.

    Words are runs without white space, A-Z lowered. Counts cover all of ``docs``. A word
    scores count(n-gram) / count(context) with the longest n-gram that ends in it and is
    found in ``min_docs`` documents at least; every word of context given up costs a
    factor ``alpha``. A word that too few documents hold scores alpha^n / all words.
    log_micro sums natural logarithms in millionths, each rounded, so that the sum does
    not depend on order; n_top counts words that kept the longest context.

    Null, empty and blank texts have 0 words and score 0. Rows that repeat are documents
    of their own and vouch for each other. Null ids are kept. An empty table gives an
    empty table. Other columns are ignored. A very long text is a chunk of its own.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType()))]
    packed = T.StructType([T.StructField("chunk", T.LongType()), *fields, T.StructField("blob", T.BinaryType()), T.StructField("bytes", T.LongType()), T.StructField("words", T.LongType())])
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    with passing(spark) as kept, shuffles_dropped(spark):
        chunks = materialize(rows.mapInArrow(_chunks(to_arrow_schema(packed), chunk_bytes), packed), "chunks")
        kept.append(chunks)
        words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        texts = chunks.select("chunk", "lengths", "blob")
        told: list[DataFrame] = []
        for n in range(1, order + 1):
            parts = 1 if n == 1 else ROUNDS
            if n == 1:
                exploded = [texts.mapInArrow(_explode_words, _GRAMS)]
            elif n == 2:
                exploded = [texts.mapInArrow(_explode_pairs(r, parts), _GRAMS) for r in range(parts)]
            else:
                exploded = [_meet(texts, _union(told)).applyInArrow(_explode(n, r, parts), _GRAMS) for r in range(parts)]
            same = Window.partitionBy("gram")
            for rows_ in exploded:
                counted = rows_.withColumns({"c": F.sum("n").over(same), "docs": F.sum("d").over(same)}).filter(F.col("docs") >= min_docs)
                # A chunk's counts of a round in one row: as many as a chunk has n-grams at most.
                gathered = counted.groupBy("chunk").agg(F.collect_list(F.struct("at", "c")).alias("told"))
                told.append(materialize(gathered.select("chunk", F.lit(n).alias("size"), "told.at", "told.c"), "told"))
        kept += told
    out = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_top", "log_micro"))])
    return _meet(chunks, _union(told)).applyInArrow(_score(order, alpha, int(words), to_arrow_schema(out)), out)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _meet(chunks: DataFrame, told: DataFrame) -> PandasCogroupedOps:
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk"))
