"""Byte-level BPE against the library that the public file belongs to."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from commitlens.llm import bpe
from commitlens.llm.q_bpe import FILE, op12_bpe
from tests.llm.helpers import FOLDER, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(library, text):
    wanted = library.encode(text, add_special_tokens=False).ids
    found = bpe.load(FILE).ids(text)
    assert found == wanted
    assert bpe.load(FILE).text(found) == library.decode(wanted, skip_special_tokens=False)


def test_letters_numbers_and_spaces_are_those_of_the_library(library):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for first in "a1! ":
        for at in range(0, len(signs), 5000):
            text = "\n".join(first + c for c in signs[at : at + 5000])
            cut = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(text)]
            assert "".join(bpe.words(text)) == text
            assert len(cut) == len(bpe.words(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(library, text):
    same(library, text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n", "  a  b \t\n\n c ", "it's I'LL they've", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext|", "é" * 500, "a\x00b", "ab" * 3000, " " * 3000, "౜a1\U00011de0b", " x　y\x85z"],
)
def test_given_text(library, text):
    same(library, text)


def test_merges_are_the_leftmost_of_the_lowest_rank():
    rng = random.Random(3)
    for _ in range(300):
        ranks = {(a, b): (r, 4 + r) for r, (a, b) in enumerate(rng.sample([(a, b) for a in range(9) for b in range(9)], 12))}
        pairs = {a << bpe.BITS | b: r << bpe.BITS | new for (a, b), (r, new) in ranks.items()}
        start = [rng.randrange(4) for _ in range(rng.randrange(40))]
        slow = list(start)
        while True:
            places = [(ranks[p][0], i) for i, p in enumerate(zip(slow, slow[1:])) if p in ranks]
            if not places:
                break
            i = min(places)[1]
            slow[i : i + 2] = [ranks[slow[i], slow[i + 1]][1]]
        assert bpe.merged(start, pairs) == slow


def test_a_very_long_word(library):
    same(library, "".join(random.Random(1).choices("abcde", k=100_000)))


def test_ids_beyond_the_vocabulary_and_broken_utf8():
    vocabulary = bpe.load(FILE)
    assert vocabulary.text([999_999]) == ""
    assert vocabulary.text([vocabulary.of_byte[0xC3]]) == "�"


def test_other_files_are_refused(tmp_path):
    file = json.load(open(FILE))
    file["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "t.json"))


def test_rows_pass_through(spark):
    rows = [(1, "one two"), (1, "one two"), (None, None), (3, ""), (4, "long " * 20_000)]
    docs = documents(spark, rows).withColumnsRenamed({"source": "ids", "lang": "decoded"})
    found = bpe.decoded(bpe.encoded(docs, FILE), FILE, ids_col="ids_")
    assert found.columns == [*docs.columns, "ids_", "decoded_"]
    got = sorted(found.collect(), key=repr)
    assert len(got) == 5
    assert all(r.decoded_ == (r.text or "") and r.ids == "s" for r in got)
    assert [r.ids_ for r in got if r.doc_id in (None, 3)] == [[], []]
    empty = bpe.encoded(docs.limit(0), FILE)
    assert bpe.decoded(empty, FILE, ids_col="ids_").count() == 0


def test_query_agrees_with_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    wanted = []
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        wanted.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op12_bpe(spark, FOLDER).collect())) == sorted(wanted)
