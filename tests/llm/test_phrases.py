"""Collocations against plain counting and against SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from commitlens.llm.phrases import END, Mining, collocations, counts, tokens
from commitlens.llm.q_phrases import SQL, op11_phrases
from tests.llm.helpers import FOLDER, documents, duck, same_rows


def brute(rows, support=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in candidates.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items() if len(p) == 2):
                continue
            score, _, left, right = min(
                (1_000_000 * a * a // (count[p[:c]] * count[p[c:]]), c, count[p[:c]], count[p[c:]]) for c in range(1, len(p))
            )
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [
            (lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])
        ]
    return sorted(out)


def texts(seed, count, kinds=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(kinds)] + ["É", "Up", "a\xa0b"]
    rows = []
    for i in range(count):
        picks = [rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "  \t"]) for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(picks), rng.choice(["en", "de", None, "und"])))
    return rows


def table(spark, rows):
    return documents(spark, [(i, t, x, "s") for i, t, x in rows])


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_agrees_with_plain_counting(spark, shards):
    rows = texts(shards, 200)
    found = collocations(table(spark, rows).repartition(3), mining=Mining(shards=shards, bits=1 << 16))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_a_small_bitmap_only_costs_time(spark):
    rows = texts(9, 80)
    found = collocations(table(spark, rows), mining=Mining(bits=8, top=7))
    assert sorted(map(tuple, found.collect())) == brute(rows, top=7)


def test_full_tasks_send_what_they_hold(spark, monkeypatch):
    rows = texts(11, 150, kinds=40)
    found = collocations(table(spark, rows).repartition(3), mining=Mining(held=64))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    from commitlens.llm import phrases

    monkeypatch.setattr(phrases, "CHUNK", 8)
    parts = list(tokens(b"A b. c\td, e f g h i j k l. m"))
    assert len(parts) > 2
    assert [w for part in parts for w in part if w != END] == b"a b c d e f g h i j k l m".split()
    assert b" ".join(w for part in parts for w in part).count(END + b" e f g h i j k l " + END) == 1


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    from commitlens.llm import phrases

    a, b = 4_000_000_007, 4_000_000_000_003
    given = [("en", 0, b"", 9 * b), ("en", 1, b"x", b), ("en", 1, b"y", b), ("en", 2, b"x y", a)]
    frame = spark.createDataFrame([(x, k, bytearray(p), n) for x, k, p, n in given], "lang string, k int, phrase binary, a long")
    monkeypatch.setattr(phrases, "counts", lambda *_: frame)
    (row,) = collocations(frame).collect()
    assert tuple(row) == ("en", 1, "x y", a, b, b, 9 * b, 1_000_000 * a * a // (b * b))


def test_one_frequent_phrase_in_all_shards(spark):
    rows = [(i, f"only here u{i}", "en") for i in range(10)] + [(99, "only there " * 9, "en")]
    assert sorted(map(tuple, collocations(table(spark, rows)).collect())) == brute(rows)


def test_edge_cases(spark):
    empty = table(spark, []).withColumnRenamed("source", "phrase")
    assert collocations(empty).count() == 0
    assert counts(empty).count() == 0
    rows = [(1, None, None), (None, "", "en"), (3, " . , ", None), (4, "a b " * 50_000, "en"), (4, "a b " * 50_000, "en"), (5, "long" * 30_000, None)]
    named = table(spark, rows).withColumnsRenamed({"source": "phrase", "n_chars": "k"})
    assert sorted(map(tuple, collocations(named).collect())) == brute(rows)
    with pytest.raises(ValueError):
        collocations(named, mining=Mining(longest=4))


def test_query_agrees_with_sql(spark):
    same_rows(op11_phrases(spark, FOLDER), duck(FOLDER), SQL)
