"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.binding import bound
from quern.llm.common import LOWER, UPPER, WORD, look_up, materialize, passing
from quern.llm.fingerprint import fingerprint_versions, with_next
from quern.llm.line_dedup import drop_common_lines
from quern.llm.lm_score import score_documents
from quern.llm.mixing import mix_plan, taken_words
from quern.llm.near_dedup import near_duplicates
from quern.llm.pieces import encode
from quern.llm.pii import BASE, detect_pii
from quern.llm.prefix_trie import encoded_turns, prefix_trie
from quern.llm.quality import score_quality
from quern.llm.runs import periodic_runs
from quern.llm.sharding import external_shuffle, record_size
from quern.llm.topk import top_k
from quern.llm.vector_join import near_vectors
from quern.operators.ordered import ranged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SPACE_SQL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE["op1_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect_pii(docs).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(n(k) for k in BASE),
        F.sha2(joined(F.filter("pii", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)), 3).alias("max_score"),
    )


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs, shards=8).select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    versions = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")),
            F.substring(F.col("next_text"), F.lit(1), quarter),
        ),
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    return fingerprint_versions(
        versions,
        {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": ""},
        {"near_edited": ("text", "edited"), "near_next": ("text", "next_text")},
    )


@_query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLE["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed, pieces = mix_plan(docs, share=(3, 2), epochs=2)
    return taken_words(placed, pieces).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('20240101:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src_at FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE src_at % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(n) OVER () AS total FROM per
), filling AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY n * (10 // w), src_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY n * (10 // w), src_at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft
  FROM weighed
), flagged AS (
  SELECT *, w * (3 * total - 4 * before) >= 4 * n * wleft AS isfull FROM filling
), leveled AS (
  SELECT *, CAST(3 * total - 4 * coalesce(sum(n) FILTER (WHERE isfull) OVER (), 0) AS DOUBLE)
            / CAST(2 * sum(w) FILTER (WHERE NOT isfull) OVER () AS DOUBLE) AS level
  FROM flagged
), targets AS (
  SELECT source, n, CASE WHEN isfull THEN CAST(2 * n AS DOUBLE) ELSE level * CAST(w AS DOUBLE) END AS target FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, CAST(t.n AS BIGINT) AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS a
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(a + size, quota) - a) + greatest(0, least(source_size + a + size, quota) - source_size - a) AS BIGINT) AS taken
FROM placed
"""


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def _mean_log(scored: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.col("log_micro") / (F.lit(1e6) * F.col("n_words"))).otherwise(0.0)
    return scored.withColumn("mean_log", mean)


@_query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_log(score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), order=2, alpha=0.4))


ORACLE["op6_lm_scoring"] = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), pairs AS (
  SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS p FROM words
), total AS (
  SELECT count(*) AS n FROM words
), one AS (
  SELECT w, count(*) AS c FROM words GROUP BY w HAVING count(DISTINCT r) >= 2
), two AS (
  SELECT p, w, count(*) AS c FROM pairs WHERE p IS NOT NULL GROUP BY p, w HAVING count(DISTINCT r) >= 2
), scored AS (
  SELECT pairs.r, CASE WHEN two.c IS NOT NULL THEN 2 WHEN one.c IS NOT NULL THEN 1 ELSE 0 END AS level,
         CASE WHEN i > 1 THEN 2 ELSE 1 END AS most,
         CASE WHEN two.c IS NOT NULL THEN ln(two.c / before.c) WHEN one.c IS NOT NULL THEN ln(one.c / n) ELSE -ln(n) END AS value
  FROM pairs CROSS JOIN total
  LEFT JOIN two ON pairs.p = two.p AND pairs.w = two.w
  LEFT JOIN one ON pairs.w = one.w
  LEFT JOIN one before ON pairs.p = before.w
), sums AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE level = 2) AS n_top,
         sum(CAST(floor((value + (most - level) * ln(0.4)) * 1e6 + 0.5) AS BIGINT)) AS log_micro
  FROM scored GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_top, 0) AS n_top, CAST(coalesce(log_micro, 0) AS BIGINT) AS log_micro,
       CASE WHEN n_words > 0 THEN log_micro / (1e6 * n_words) ELSE 0.0 END AS mean_log
FROM split LEFT JOIN sums USING (r)
"""

@_query
def op6_lm_trigram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid backoff from trigrams to bigrams to words."""
    return _mean_log(score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), order=3, alpha=0.4))


ORACLE["op6_lm_trigram_scoring"] = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), grams AS (
  SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS p, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS o FROM words
), total AS (
  SELECT count(*) AS n FROM words
), one AS (
  SELECT w, count(*) AS c FROM words GROUP BY w HAVING count(DISTINCT r) >= 2
), two AS (
  SELECT p, w, count(*) AS c FROM grams WHERE p IS NOT NULL GROUP BY p, w HAVING count(DISTINCT r) >= 2
), three AS (
  SELECT o, p, w, count(*) AS c FROM grams WHERE o IS NOT NULL GROUP BY o, p, w HAVING count(DISTINCT r) >= 2
), scored AS (
  SELECT grams.r, CASE WHEN three.c IS NOT NULL THEN 3 WHEN two.c IS NOT NULL THEN 2 WHEN one.c IS NOT NULL THEN 1 ELSE 0 END AS level,
         least(i, 3) AS most,
         CASE WHEN three.c IS NOT NULL THEN ln(three.c / earlier.c) WHEN two.c IS NOT NULL THEN ln(two.c / before.c)
              WHEN one.c IS NOT NULL THEN ln(one.c / n) ELSE -ln(n) END AS value
  FROM grams CROSS JOIN total
  LEFT JOIN three ON grams.o = three.o AND grams.p = three.p AND grams.w = three.w
  LEFT JOIN two ON grams.p = two.p AND grams.w = two.w
  LEFT JOIN one ON grams.w = one.w
  LEFT JOIN two earlier ON grams.o = earlier.p AND grams.p = earlier.w
  LEFT JOIN one before ON grams.p = before.w
), sums AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE level = 3) AS n_top,
         sum(CAST(floor((value + (most - level) * ln(0.4)) * 1e6 + 0.5) AS BIGINT)) AS log_micro
  FROM scored GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_top, 0) AS n_top, CAST(coalesce(log_micro, 0) AS BIGINT) AS log_micro,
       CASE WHEN n_words > 0 THEN log_micro / (1e6 * n_words) ELSE 0.0 END AS mean_log
FROM split LEFT JOIN sums USING (r)
"""


#: The model that op9 and the pipeline encode with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def piece_digests(docs: DataFrame, model: str = PIECE_MODEL, *, viterbi: bool = False) -> DataFrame:
    """doc_id, pieces and the text they decode to, as digests."""
    ids = F.array_join(F.col("pieces").cast("array<string>"), ",")
    return encode(docs.select("doc_id", "text"), model, decoded="decoded", viterbi=viterbi).select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.sha2(ids, 256).alias("pieces_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@_query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's ids: of a merge model, so no scores are relaxed (see :func:`encode`)."""
    return piece_digests(_table(spark, sf_dir, "documents"))


@_query
def op9_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces as a unigram model: the segmentation with the best sum of scores."""
    return piece_digests(_table(spark, sf_dir, "documents"), viterbi=True)


def _periodic(doc_id, text):
    """The text that op11 is asked about: a tenth of the documents repeat a stretch of their
    words, picked by the checksum of their id, up to their end."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(words):
        g, n = F.floor(crc / 10).cast("long"), F.size(words).cast("long")
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        rest = (n - a).cast("int")
        times = F.ceil(rest / p).cast("int")
        return F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), rest))

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    chosen = (crc % 10 == 0) & text.rlike(WORD)
    return F.when(chosen, bound(words, lambda w: F.array_join(repeated(w), " "))).otherwise(text)


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _periodic(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs, min_length=12).withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


ORACLE["op13_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r,
         CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings
), links AS (
  SELECT a.r AS u, b.r AS v FROM v a JOIN v b ON a.r <> b.r AND a.e IS NOT NULL AND b.e IS NOT NULL
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT u AS r, v AS other FROM links
  UNION
  SELECT reach.r, links.v FROM reach JOIN links ON reach.other = links.u
), least AS (
  SELECT reach.r, min(o.vec_id) AS least FROM reach JOIN v o ON o.r = reach.other GROUP BY reach.r
), counted AS (
  SELECT u AS r, count(*) AS n FROM links GROUP BY u
), out AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.least, vec_id)) AS component_id
  FROM v LEFT JOIN least USING (r) LEFT JOIN counted USING (r)
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM out
"""


def _rebuilt(turns: DataFrame, *, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of the conversations that op12 is asked about: the first h turns of the
    first conversation of its hundred, then its own behind its first h."""
    def opening(c):
        return F.crc32(c.cast("string").cast("binary")) % (most + 1)

    lengths = turns.groupBy("conv").agg(F.max("at").alias("own")).withColumn("base", F.col("conv") - F.col("conv") % family)
    heads = lengths.filter("conv = base").select(F.col("base").alias("b"), F.col("own").alias("held"))
    convs = lengths.join(heads, F.col("base") == F.col("b"), "left").withColumns({"h": opening(F.col("conv")), "held": F.coalesce("held", F.lit(0))})
    convs = convs.withColumn("taken", F.least("h", "held"))
    convs = materialize(convs.select("conv", "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = turns.filter((F.col("conv") % family == 0) & (F.col("at") <= most)).withColumnRenamed("conv", "base")
    opened = convs.select("conv", "base", "h").join(first, "base").filter("at <= h").select("conv", "at", "turn_id", "n_chars")
    rest = look_up(turns, convs.select("conv", "own", "h", "taken"), ["conv"], "own", F.col("at")).filter("at > h")
    rest = rest.select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "turn_id", "n_chars")
    return materialize(opened.unionByName(rest), "rebuilt"), convs.select("conv", "length")


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's comma-joined parts, which follow one another."""
    node, digest = None, None
    for batch in batches:
        for conv, depth, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (conv, depth) != node:
                if node:
                    yield pa.RecordBatch.from_pydict({"e_conv": [node[0]], "e_depth": [node[1]], "digest": [digest.hexdigest()]})
                node, digest = (conv, depth), hashlib.sha256(part.encode())
            else:
                digest.update(b"," + part.encode())
    if node:
        yield pa.RecordBatch.from_pydict({"e_conv": [node[0]], "e_depth": [node[1]], "digest": [digest.hexdigest()]})


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(e_conv, e_depth, digest). Ids are joined in ranges; of a node whose ids fill several
    ranges the parts, a row a range, are digested one after another."""
    cut = ranged(ends, [F.col("conv_id"), F.col("depth"), F.col("conv")])
    part = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    parts = cut.groupBy("conv_id", "depth", "_range").agg(part.alias("part"))
    parts = materialize(parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "depth"))), "parts")
    whole = parts.filter("n = 1").select(F.col("conv_id").alias("e_conv"), F.col("depth").alias("e_depth"), F.sha2("part", 256).alias("digest"))
    cuts = parts.filter("n > 1").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "_range").select("conv_id", "depth", "part")
    return whole.unionByName(cuts.mapInArrow(_digest_parts, "e_conv long, e_depth long, digest string"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with passing(spark) as kept:
        turns = materialize(encoded_turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "numbered")
        nodes, ends = prefix_trie(*_rebuilt(turns))
        on = (F.col("conv_id") == F.col("e_conv")) & (F.col("depth") == F.col("e_depth"))
        out = nodes.join(_ends_digest(ends), on, "left").withColumn("ends_sha256", F.coalesce("digest", F.sha2(F.lit(""), 256)))
        out = materialize(out.drop("e_conv", "e_depth", "digest"), "trie")
        kept.append(out)
    return out


#: DuckDB has no crc32: bit by bit, as a list of steps (a byte, then eight shifts).
ORACLE["op12_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos,
         md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
           list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)
), opened AS (
  SELECT convs.c, o.pos, o.k, o.chars FROM convs JOIN own o ON o.c = convs.base AND o.pos <= convs.h
), taken AS (
  SELECT c, count(*) AS n FROM opened GROUP BY c
), turns AS (
  SELECT * FROM opened
  UNION ALL
  SELECT o.c, o.pos - convs.h + coalesce(taken.n, 0), o.k, o.chars FROM own o JOIN convs USING (c) LEFT JOIN taken USING (c) WHERE o.pos > convs.h
), pre AS (
  SELECT c, 0 AS d, '' AS key, 0 AS chars FROM convs
  UNION ALL
  SELECT c, pos, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY pos)), chars FROM turns
), lengths AS (
  SELECT c, max(d) AS n FROM pre GROUP BY c
), nodes AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM pre GROUP BY key, d
), linked AS (
  SELECT nodes.*, p.key AS up FROM nodes LEFT JOIN pre p ON p.c = nodes.conv_id AND p.d = nodes.d - 1
), children AS (
  SELECT up AS key, d - 1 AS d, count(*) AS n FROM linked WHERE d > 0 GROUP BY up, d
), subtree AS (
  SELECT a.key, a.d, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (WHERE children.n IS NULL) AS leaves
  FROM nodes n JOIN pre a ON a.c = n.conv_id AND a.d <= n.d LEFT JOIN children ON children.key = n.key AND children.d = n.d
  GROUP BY a.key, a.d
), ends AS (
  SELECT key, d, string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) AS ids FROM pre JOIN lengths ON lengths.c = pre.c AND lengths.n = pre.d GROUP BY key, d
)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, l.n_convs, coalesce(children.n, 0) AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM linked l JOIN subtree s ON s.key = l.key AND s.d = l.d LEFT JOIN nodes parent ON parent.key = l.up AND parent.d = l.d - 1
LEFT JOIN children ON children.key = l.key AND children.d = l.d LEFT JOIN ends ON ends.key = l.key AND ends.d = l.d
"""
