import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from commitlens.llm.licenses import TEMPLATES, licences
from commitlens.llm.q_licenses import files, op4_licenses

#: The smallest tables have no licence file that another file could inherit from.
FOLDER = "/root/testdata/sf0.01"

TERM = re.compile(r"[^\W_]+")


def brute(rows, least=0.8):
    """path -> (licence, origin), by plain loops."""
    texts = {p: (t or "").lower() for p, t in rows}
    notes = {i: Counter(TERM.findall(t.lower())) for i, t in TEMPLATES}
    vocabulary = set().union(*notes.values())
    df = Counter(t for _, x in rows for t in set(TERM.findall((x or "").lower())) & vocabulary)
    n = len(rows)
    idf = {t: math.log((n + 1) / max(df[t], 1)) for t in vocabulary}
    own = {}
    for p, text in texts.items():
        best = []
        for line in text.split("\n"):
            c = Counter(TERM.findall(line))
            size = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items() if t in vocabulary) + sum(t not in vocabulary for t in c) * math.log(n + 1) ** 2)
            for i, note in notes.items():
                norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in note.items()))
                dot = sum(c[t] * k * idf[t] ** 2 for t, k in note.items())
                if size * norm > 0 and round(dot / (size * norm), 9) >= least:
                    best.append((-round(dot / (size * norm), 9), i))
        if best:
            own[p] = min(best)[1]
    out = {}
    for p in texts:
        if p in own:
            out[p] = (own[p], "own")
            continue
        folder = p.rpartition("/")[0]
        while True:
            there = sorted(q for q in own if q.rpartition("/")[0] == folder and q.rpartition("/")[2].startswith(("LICENSE", "COPYING")))
            if there or not folder:
                out[p] = (own[there[0]], "inherited") if there else (None, None)
                break
            folder = folder.rpartition("/")[0]
    return out


def test_query_against_plain_loops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.path, r.text) for r in files(docs).collect()]
    got = {r.path: (r.licence, r.origin) for r in op4_licenses(spark, FOLDER).collect()}
    want = brute(rows)
    assert got == want
    assert {"own", "inherited"} <= {o for _, o in got.values()}


def test_nearest_directory_and_edges(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit), ("a/COPYING", apache), ("a/b/c.txt", None), ("a/b/d.txt", "code\n" + mit + "\n" + "word " * 20_000), ("x/y.txt", ""), ("x/y.txt", ""), ("top", "nothing"), (None, mit), ("a/LICENSE.md", mit), ("a//b/e", "z")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("score", F.lit("own"))
    found = licences(df)
    assert found.columns == ["path", "score", "licence", "score_", "origin", "origin_path"]
    got = sorted((str(r.path), str(r.licence), str(r.origin_path)) for r in found.collect())
    assert got == sorted(
        [("LICENSE", "MIT", "LICENSE"), ("a/COPYING", "Apache-2.0", "a/COPYING"), ("a/b/c.txt", "Apache-2.0", "a/COPYING"), ("a/b/d.txt", "MIT", "a/b/d.txt"),
         ("x/y.txt", "MIT", "LICENSE"), ("x/y.txt", "MIT", "LICENSE"), ("top", "MIT", "LICENSE"), ("None", "None", "None"), ("a/LICENSE.md", "MIT", "a/LICENSE.md"), ("a//b/e", "Apache-2.0", "a/COPYING")]
    )
    assert licences(df.limit(0)).count() == 0


def full_scores(rows, least):
    """path -> (licence, score), with the document frequencies of all terms and without bounds."""
    n, df = len(rows), Counter(t for _, x in rows for t in set(TERM.findall((x or "").lower())))
    idf = lambda t: math.log((n + 1) / max(df[t], 1))
    notes = {i: Counter(TERM.findall(t.lower())) for i, t in TEMPLATES}
    length = lambda c: math.sqrt(sum((k * idf(t)) ** 2 for t, k in c.items()))
    found = {}
    for p, text in rows:
        for line in (text or "").lower().split("\n"):
            c = Counter(TERM.findall(line))
            for i, note in notes.items():
                if (whole := length(c) * length(note)) > 0:
                    score = round(sum(c[t] * k * idf(t) ** 2 for t, k in note.items()) / whole, 9)
                    if score >= least and (p not in found or (-score, i) < found[p]):
                        found[p] = (-score, i)
    return {p: (i, -minus) for p, (minus, i) in found.items()}


def test_frequencies_of_all_terms_count_all_documents(spark):
    rng = random.Random(5)
    everyday = ["en", "this", "file", "is"]
    rows = [(f"d/{i}", " ".join([*everyday, *(f"w{rng.randrange(900)}" for _ in range(30))])) for i in range(400)]
    rows += [
        ("a/1", "Released under the MIT License en"), ("a/2", "This file is released under the MIT License."),
        ("a/3", "Released under the MIT License w1 w2 w3"), ("a/4", "Released under the MIT License " + "rare " * 9), ("a/5", "w5 en\nlicensed under CC BY 4.0, en file"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.score) for r in licences(df).collect() if r.licence}
    want = full_scores(rows, 0.8)
    assert {p: i for p, (i, _) in got.items()} == {p: i for p, (i, _) in want.items()}
    assert all(got[p][1] == pytest.approx(want[p][1], abs=2e-9) for p in want)
    assert {"a/1", "a/2", "a/5"} <= set(got) and "a/4" not in got
