import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commitlens.llm import pieces
from commitlens.llm.q_pieces import MODEL, op9_sentencepiece

from .helpers import FOLDER, documents

MODEL_ = pieces.load(MODEL)


def every_path(text):
    """All segmentations with their scores, by recursion."""
    marked = (pieces.MARK + text.replace(" ", pieces.MARK)) if text else ""

    def ways(rest):
        if not rest:
            return [(0.0, ())]
        out = []
        for k in range(1, len(rest) + 1):
            i = MODEL_.ids.get(rest[:k])
            if i is not None:
                head, cost = (i,), MODEL_.scores[i]
            elif k == 1:
                head, cost = tuple(MODEL_.byte_ids[b] for b in rest[0].encode()), MODEL_.unknown
            else:
                continue
            out += [(cost + c, head + p) for c, p in ways(rest[k:])]
        return out

    return sorted(ways(marked), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", "a", "the cat", "  a b", "x\ny z", "né\t中", "aaaa", "in on at it", "ü\U0001f600 a", " "])
@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_n_best_against_every_path(text, n):
    want = every_path(text)
    ids, paths = pieces.encode(MODEL_, text, n)
    assert [s for s, _ in paths] == [s for s, _ in want[: len(paths)]]
    assert len(paths) == min(n, len(want))
    got = [tuple(pieces.apply_edits(ids, e)) for _, e in paths]
    assert len(set(got)) == len(got)
    scores = dict((p, s) for s, p in want)
    assert [scores[p] for p in got] == [s for s, _ in paths] and got[0] == tuple(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_round_trip(text):
    ids, paths = pieces.encode(MODEL_, text, 3)
    for _, edits in paths:
        assert pieces.decode(MODEL_, pieces.apply_edits(ids, edits)) == text


def test_scores_against_the_library():
    """The same scores as the library's own search, run as a unigram model over the same pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["the thing over there", "Straße und Öl", "a few words more"]:
        theirs = sp.nbest_encode_as_ids(text, 4)
        ids, paths = pieces.encode(MODEL_, text, 4)
        score = lambda p: sum(float(MODEL_.scores[i]) for i in p)
        assert [score(p) for p in theirs] == [s for s, _ in paths]


def test_memo_limit_and_order_of_words_do_not_matter(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    plain = lambda found: (found[0].tolist(), found[1])
    want = plain(pieces.encode(MODEL_, " ".join(words), 4))
    monkeypatch.setattr(pieces, "MEMO", 10)
    for a, b in itertools.pairwise(range(0, 300, 60)):
        pieces.encode(MODEL_, " ".join(words[a:b]), 2)
    assert plain(pieces.encode(MODEL_, " ".join(words), 4)) == want


def test_very_long_text_without_spaces():
    text = "abcde▁" * 3000
    ids, paths = pieces.encode(MODEL_, text, 2)
    assert pieces.decode(MODEL_, ids) == text and len(paths) == 2 and paths[0][0] >= paths[1][0]


def test_null_empty_and_clashing_columns(spark):
    docs = documents(spark, [(1, None), (2, ""), (None, "a b"), (None, "a b")]).withColumn("ids", F.lit(5))
    found = pieces.decoded(pieces.encoded(docs, MODEL, n=2), MODEL, "ids_")
    assert found.columns[-3:] == ["ids_", "paths", "decoded"]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].ids_ is None and rows[1].decoded is None
    assert rows[2].ids_ == [] and rows[2].decoded == "" and rows[2].paths[0].score == 0
    assert rows[None].decoded == "a b" and found.count() == 4
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0


def test_query_round_trips_every_document(spark):
    rows = op9_sentencepiece(spark, FOLDER).select("round_trip", "n_pieces", F.size("paths").alias("p")).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.round_trip for r in rows) and max(r.p for r in rows) == 4
