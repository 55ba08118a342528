"""What the tests of this folder share."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "embeddings", "conversations")


def connect(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def same_rows(df, cur):
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def words_of(text):
    """As the contracts split words: at 0x20 and 0x09 to 0x0D only."""
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
