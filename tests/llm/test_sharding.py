import zlib
from collections import Counter

import pytest
from helpers import SF

from quern.llm.queries import QUERIES
from quern.llm.sharding import external_shuffle, write_shards

SCHEMA = "doc_id long, text string"
ROWS = [(i, f"text {i} " * (i % 7)) for i in range(100)] + [(None, "x"), (None, None), (5, None), (5, "x"), (7, "same"), (7, "same"), (8, ""), (9, "long " * 60_000)]


def laws(rows, shards, n):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("size", [1 << 21, 200, 1])
def test_the_law_of_rows_holds_and_nothing_is_lost(spark, size):
    rows = external_shuffle(spark.createDataFrame(ROWS, SCHEMA), shards=8, bucket_bytes=size).collect()
    laws(rows, 8, len(ROWS))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(ROWS)


def test_places_do_not_depend_on_files_and_partitions_but_on_the_seed(spark):
    def places(df, **options):
        return Counter((r.doc_id, r.text, r.shard, r.slot) for r in external_shuffle(df, shards=4, bucket_bytes=300, **options).collect())

    rows = [r for r in ROWS if r != (7, "same")]
    df = spark.createDataFrame(rows, SCHEMA)
    one = places(df.repartition(1))
    assert one == places(df.repartition(7)) == places(spark.createDataFrame(rows[::-1], SCHEMA))
    assert one != places(df, seed=5)


def test_every_order_of_a_bucket_occurs(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(3)], SCHEMA)
    orders = {tuple(r.doc_id for r in sorted(external_shuffle(df, shards=1, seed=s).collect(), key=lambda r: r.slot)) for s in range(40)}
    assert len(orders) == 6


def test_an_empty_table_clashing_names_and_written_shards(spark, tmp_path):
    assert external_shuffle(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "a", "s", 9)], SCHEMA + ", shard string, size int")
    assert [tuple(r) for r in external_shuffle(clash, shards=2).collect()] == [(1, "a", 9, 1, 0)]
    write_shards(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    laws(back, 3, len(ROWS))


def test_the_query_keeps_its_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_sharding"](spark, SF).collect()
    laws(rows, 8, len(docs))
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
