import hashlib
import random
from collections import Counter

import duckdb
import pytest
import sentencepiece
from helpers import lower, words_of

import corpus_pipeline as cp
from quern.llm.queries import ORACLE, PIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "rho")) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents, half of them junk, with labels, a shared line, copies, nulls and repeats."""
    rng, rows, labels = random.Random(6), [], []
    for i in range(240):
        good = i % 2 == 0
        text = f"{prose(rng, 50)}\nshared line\n{prose(rng, 20)}" if good else "".join(rng.choice("!?#$%&*") for _ in range(200)) + " 0" * 30
        rows.append((i, text, "en", ("a", "b", None)[i % 3], 7))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[2 * i][1], "en", "a", 1) for i in range(10)]  # copies
    rows += [(3000, rows[20][1] + " more", "en", "b", 1), (3000, rows[22][1], "en", "b", 1), (None, rows[24][1], "en", "b", 1)]  # near copies, one id, no id
    rows += [(4000, prose(rng, 60), None, "b", None)] * 2  # repeated entirely
    rows += [(5000, None, None, None, None), (5001, "", "en", "a", 0), (5002, prose(rng, 30_000), "en", "c", 5)]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def staged(spark, tables, upto):
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in cp.STAGES[:upto]:
        docs = stage(spark, docs, at)
    return docs


def test_quality_keeps_clean_documents_and_drops_junk(spark, tables):
    kept = {r.doc_id for r in staged(spark, tables, 1).collect()}
    assert {i for i in range(240) if i % 2 == 0} <= kept and not kept & {i for i in range(240) if i % 2}


def test_line_dedup_takes_the_shared_line_only(spark, tables):
    before = Counter((r.doc_id, "\n".join(x for x in r.text.split("\n") if lower(x.strip()) != "shared line")) for r in staged(spark, tables, 1).collect() if r.text)
    after = staged(spark, tables, 2).collect()
    assert all(r.n_chars == len(r.text) for r in after)
    counts = Counter(x for r in after for x in set(r.text.split("\n")) if x)
    assert max(counts.values()) < 10 + 3
    assert {(r.doc_id, r.text) for r in after if r.text and "shared line" not in r.text} <= set(before) | {(d, t) for d, t in before}


def test_near_dedup_keeps_one_row_a_group(spark, tables):
    before, after = staged(spark, tables, 2).collect(), staged(spark, tables, 3).collect()
    ids = Counter(r.doc_id for r in after)
    assert not any(1000 <= (i or 0) < 1010 for i in ids) and None not in ids and not ids.get(3000)
    assert ids.get(4000, 0) <= 1 and {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 240} <= set(ids)


def test_mixing_takes_the_words_that_the_targets_say(spark, tables, tmp_path):
    """By the SQL of op3, which states how many words of each document the mix takes."""
    staged(spark, tables, 3).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = Counter()
    for doc_id, taken in con.execute(f"SELECT doc_id, taken FROM ({ORACLE['op3_mixing']})").fetchall():
        want[doc_id] += taken
    got = Counter()
    for r in cp.mix_sources(spark, spark.read.parquet(str(tmp_path / "documents")), "").collect():
        got[r.doc_id] += len(words_of(r.text))
    assert +want == got and sum(got.values()) > 1000


def test_pieces_equal_the_library(spark, tables):
    """Ids and their decoding as the tokenizer's own library gives them."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    docs = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(tables[1][:60]) if t], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in cp.encode_pieces(spark, docs, "").collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.pieces_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_the_whole_run_equals_its_stages_and_leaves_no_scratch(spark, tables):
    at, rows = tables
    mixed = staged(spark, tables, 4).collect()
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    got = cp.run(spark, at).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want and all(r.round_trip for r in got)
    assert set(got[0].asDict()) == {"doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "round_trip"}


def test_an_empty_table(spark, tables, tmp_path):
    at, _ = tables
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{at}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_with_clashing_names(spark, tables):
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "'x' as label", "1 as found", "2 as mix_slot", "3 as kept_text", "4 as rec")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert tuple(docs.columns) == cp.COLUMNS
    assert cp.STAGES[-1][1](spark, docs, at).count() > 50
