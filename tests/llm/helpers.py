"""Small tables for the tests of the training-data operators."""

import os

import duckdb

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows are (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "s")[len(r) - 2 :])[:4] for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCUMENTS)


def brute_components(nodes, linked):
    """Smallest node reachable from each node, by comparing all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def same_rows(df, con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    theirs = sorted((list(r) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
