"""Rows and helpers shared by the tests of the training-data operators."""

import tempfile

import duckdb

from barloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three", "en", "a", 1), (3, " \t\n ", "en", "b", 3),
    (4, "Same text here, it is the same.", "en", "a", 1), (4, "Same text here, it is the same.", "en", "a", 1), (4, "another text", "en", None, 1),
    (5, "word " * 30000, "en", "a", 1), (6, "日本語 👍 ＡＢＣ <|endoftext|> x\x1cy\x85z", "ja", "b", 1), (7, "It's 'S we'LL ΣΑΣ İx", "el", "b", 1),
]


def empty(df):
    return df.limit(0)


def compare(spark, name, frames):
    """The registered query against its SQL over small tables."""
    folder = tempfile.mkdtemp(prefix="barloom-test-")
    con = duckdb.connect()
    for table, df in frames.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: str(r)
    want = sorted(cur.fetchall(), key=key)
    assert sorted([tuple(r[c] for c in names) for r in got.collect()], key=key) == want
    return want, names
