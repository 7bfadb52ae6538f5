import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlens.llm.q_substrings import op3_substrings
from commitlens.llm.substrings import Parsing, longest_matches, parse, repeated_spans, without_spans

from .helpers import FOLDER, documents


def brute(texts, window):
    """Kept words of each text, by counting all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    shared = [[word() for _ in range(rng.randint(4, 30))] for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    return [*texts, *texts[:3], " ".join(["a"] * 50), " ".join(["a b"] * 30), "", None]


@pytest.mark.parametrize("seed,crowd,block", [(1, 512, 1 << 18), (2, 2, 60), (3, 5, 200)])
def test_against_all_windows(spark, seed, crowd, block):
    texts = corpus(seed)
    docs = documents(spark, list(enumerate(texts)))
    found = repeated_spans(docs, parsing=Parsing(window=9, gram=3, crowd=crowd, block=block))
    kept = {r.doc_id: r.kept_text for r in without_spans(found, "text", "spans").collect()}
    want = brute(texts, 9)
    assert [kept[i] for i in range(len(texts))] == [" ".join(w) for w in want]
    assert sum(map(len, want)) < sum(len((t or "").split()) for t in texts)


def test_longest_matches_against_all_pairs():
    rng = np.random.default_rng(5)
    segments = [rng.integers(0, 3, n).astype(np.uint64) for n in (1, 30, 17, 40, 2)]
    starts = [(s, i) for s, x in enumerate(segments) for i in range(len(x))]

    def common(a, b):
        n = 0
        x, y = segments[a[0]][a[1] :], segments[b[0]][b[1] :]
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    want = [max(common(a, b) for b in starts if b != a) for a in starts]
    assert longest_matches(segments, 64).tolist() == want


def test_windows_over_a_boundary_are_found():
    # From word 0 the match is 5 long, from word 2 it is 6: the window of 6 at 2 crosses the boundary at 5.
    match = np.array([5, 4, 6, 5, 4, 3, 2, 1, 0, 0])
    assert parse(match, 6).tolist() == [False, False, True, True, True, True, True, True, False, False]


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long), (2, None), (3, ""), (4, "few words"), (4, "few words"), (5, "x " + " ".join(f"v{i}" for i in range(5000)))]
    docs = documents(spark, rows).withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("n"))
    found = without_spans(repeated_spans(docs), "text", "spans_")
    assert found.columns[-4:] == ["n_words_", "spans_", "kept_text", "n_removed"]
    got = sorted((str(r.doc_id), r.n_words_, r.n_removed) for r in found.collect())
    assert got == sorted([("None", 40, 40), ("None", 40, 40), ("2", 0, 0), ("3", 0, 0), ("4", 2, 0), ("4", 2, 0), ("5", 5001, 0)])
    assert repeated_spans(docs.limit(0)).count() == 0


def test_query_against_all_windows(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in rows], 35)
    got = {r.doc_id: r for r in op3_substrings(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r, kept in zip(rows, want, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        digest = hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (got[r.doc_id].n_words, got[r.doc_id].n_removed, got[r.doc_id].kept_sha256) == (len(words), len(words) - len(kept), digest)
    assert any(g.n_removed for g in got.values())
