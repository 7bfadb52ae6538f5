"""The whole chain against its stages worked out one by one without Spark."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from commitlens.llm import q_mixing, q_quality
from commitlens.llm.q_pieces import MODEL

from .helpers import FOLDER, brute_components
from .test_lines import brute as without_repeated_lines
from .test_simhash import plain_fingerprint

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sql_over(rows, sql):
    table = pa.table({c: pa.array([r[c] for r in rows], pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for c in COLUMNS})
    con = duckdb.connect()
    con.register("documents", table)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


def by_hand(rows):
    """How often each id comes to the last stage, and how often the mix takes it (None: it has no words)."""
    kept = {r["doc_id"] for r in sql_over(rows, q_quality.SQL) if r["kept"]}
    rows = [r for r in rows if r["doc_id"] in kept]
    texts = dict(without_repeated_lines([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r | {"text": texts[r["doc_id"]]} for r in rows]
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    root = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else None for r in sql_over(rows, q_mixing.SQL)}
    return Counter({k: n for k, n in taken.items() if n}), taken


def test_chain_against_stages_by_hand(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    wanted, taken = by_hand(rows)
    found = corpus_pipeline.run(spark, FOLDER).collect()
    # A document that has lost all its lines takes no words, however often it is taken.
    assert Counter(r.doc_id for r in found if taken[r.doc_id] is not None) == wanted
    assert all(r.round_trip for r in found)
    assert 0 < len(wanted) < len(rows)


def test_stages_pass_on_the_columns_of_their_input(spark, tmp_path):
    good = " ".join(f"w{i}rd{i * 7}" for i in range(60))
    other = " ".join(f"x{i}y{i * 5}" for i in range(70))
    rows = [(1, good, "en", "s"), (1, good, "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, other, None, None), (None, good + " z", "en", "s")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"kept": F.lit("own"), "n_lines": F.lit(1), "fingerprint": F.lit("f"), "size": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:5] == list(COLUMNS) and docs.columns[5:] == ["kept", "n_lines", "fingerprint", "size"]
    assert {r.doc_id for r in docs.collect()} <= {1, 4, None}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert all(r.round_trip for r in last.collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_nothing_to_keep(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_model_file_is_there():
    assert sentencepiece.SentencePieceProcessor(model_file=MODEL).get_piece_size() == 32_000
