"""Byte-level BPE with the merges of a public tokenizer file.

A text is cut at the file's added tokens and then into words; a word starts as
its bytes.  The ranks of its adjacent pairs are the leaves of a segment tree of
minima.  Its root says the lowest rank left in the word, and the way down that
prefers the left child ends at its leftmost place, which is the next merge.  A
merge changes three leaves (the pair itself, the one before and the one after),
each a way up of logarithmic length, so a word of n bytes takes O(n log n) steps
however long it is.  The word is done when the root holds no rank.

Texts are independent: both directions are narrow Arrow maps without a shuffle,
and a lost executor costs its tasks only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from commitlens.llm.common import append_columns, fresh, prepared

#: Words kept, and ids kept for them; the memo is emptied when it is full.
MEMO, MEMO_IDS = 1 << 18, 1 << 22
#: Ids take so many bits in the keys and values of pairs.
BITS = 24
MASK = (1 << BITS) - 1
NO_RANK = 1 << 62
#: Words of up to so many bytes are merged many at a time.
LONGEST_TOGETHER = 65
TOGETHER = 1 << 12

# The letters and numbers that came with Unicode 17 and later.  The public file's
# library takes them for other signs, as it knows Unicode 16.
NEWER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _signs(ranges: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


def _words(letters: str, numbers: str) -> regex.Pattern:
    """Contractions, words, numbers, other signs (each with a space before it), white space."""
    neither = rf"(?:(?!{letters}|{numbers}|\s)(?s:.))"
    return regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?(?:{letters})+| ?(?:{numbers})+| ?{neither}+|\s+(?!\S)|\s+"
    )


# Most texts hold none but signs up to U+024F and common punctuation; their classes can be written out.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN = re.compile(
    rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
BEYOND_LATIN = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")
PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEWER = regex.compile(f"[{_signs(NEWER_LETTERS)}{_signs(NEWER_NUMBERS)}]")
STRICT = _words(rf"(?![{_signs(NEWER_LETTERS)}])\p{{L}}", rf"(?![{_signs(NEWER_NUMBERS)}])\p{{N}}")


def words(text: str) -> list[str]:
    """The words that merges never cross; joined they are the text."""
    if not BEYOND_LATIN.search(text):
        return LATIN.findall(text)
    return (STRICT if NEWER.search(text) else PLAIN).findall(text)


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it prints, else the next sign from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def merged(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """``ids`` after all merges: of the mergeable pairs always the lowest rank, and of that the leftmost.

    ``pairs`` maps ``left << BITS | right`` to ``rank << BITS | id of the merged token``.
    """
    n = len(ids)
    if n < 2:
        return list(ids)
    ids = list(ids)
    rank = pairs.get
    leaves = 1 << (n - 2).bit_length()
    tree = [NO_RANK] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = rank(ids[i] << BITS | ids[i + 1], NO_RANK)
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        k = leaves + place
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low

    while (best := tree[1]) != NO_RANK:
        k = 1
        while k < leaves:
            k *= 2
            k += tree[k] != best
        at = k - leaves
        gone = following[at]
        after = following[at] = following[gone]
        ids[at], ids[gone] = best & MASK, -1
        if gone < n - 1:
            put(gone, NO_RANK)
        if after < n:
            before[after] = at
            put(at, rank(ids[at] << BITS | ids[after], NO_RANK))
        else:
            put(at, NO_RANK)
        if (left := before[at]) >= 0:
            put(left, rank(ids[left] << BITS | ids[at], NO_RANK))
    return [x for x in ids if x >= 0]


class Ranks:
    """``pairs`` as sorted arrays, to look up many pairs at once."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, pairs: dict[int, int]):
        order = sorted(pairs)
        self.keys = np.array([*order, NO_RANK], np.int64)
        self.ranks = np.array([*(pairs[k] >> BITS for k in order), self.NONE], np.int32)
        self.merged = np.zeros(int(self.ranks[:-1].max(initial=0)) + 1, np.int32)
        self.merged[self.ranks[:-1]] = [pairs[k] & MASK for k in order]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none or a side is below 0."""
        key = left.astype(np.int64) << BITS | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], self.NONE)


def merged_words(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """``merged`` for many short words at once, each with a segment tree of its own.

    ``ids`` has a column per word, filled up with -1 at the end; what a merge
    takes in turns to -1.  Every step makes the next merge of every word that
    has one.
    """
    n, many = ids.shape
    leaves = 1 << max(0, (n - 2).bit_length())
    tree = np.full((2 * leaves, many), ranks.NONE)
    tree[leaves : leaves + n - 1] = ranks(ids[:-1], ids[1:])
    level = leaves
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    # One more row stands for what lies before the first and after the last token.
    ids = np.vstack([ids, np.full((1, many), -1, np.int32)])
    following = np.repeat(np.minimum(np.arange(1, n + 2), n)[:, None].astype(np.int32), many, 1)
    before = np.repeat(np.array([n, *range(n)], np.int32)[:, None], many, 1)
    busy = np.flatnonzero(tree[1] != ranks.NONE)
    while len(busy):
        best = tree[1, busy]
        k = np.ones(len(busy), np.int64)
        for _ in range(leaves.bit_length() - 1):
            k *= 2
            k += tree[k, busy] != best
        at = k - leaves
        gone = following[at, busy]
        after = following[gone, busy]
        following[at, busy] = after
        before[after, busy] = at
        ids[at, busy], ids[gone, busy] = ranks.merged[best], -1
        left = before[at, busy]
        ids[n, busy] = -1
        own = ids[at, busy]
        tree[leaves + np.minimum(gone, leaves - 1), busy] = ranks.NONE
        tree[leaves + at, busy] = ranks(own, ids[after, busy])
        tree[leaves + left % n, busy] = np.where(left < n, ranks(ids[left, busy], own), tree[leaves + left % n, busy])
        words = np.concatenate([busy, busy, busy])
        k = leaves + np.concatenate([np.minimum(gone, leaves - 1), at, left % n])
        for _ in range(leaves.bit_length() - 1):
            k >>= 1
            tree[k, words] = np.minimum(tree[2 * k, words], tree[2 * k + 1, words])
        busy = busy[tree[1, busy] != ranks.NONE]
    return ids[:n]


@dataclass
class Known:
    """Ids of words one after the other, and where each word's begin."""

    number: dict[str, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.flat = np.concatenate([self.flat, flat])
        self.counts = np.concatenate([self.counts, counts])


def gathered(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` (cut by ``counts``) one after the other, and where each ends."""
    starts = (np.cumsum(counts) - counts)[which]
    own = counts[which]
    ends = np.cumsum(own)
    return flat[np.repeat(starts - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], ends


@dataclass
class Vocabulary:
    """Merges, bytes and added tokens of a file, and a memo of words."""

    of_byte: np.ndarray
    pairs: dict[int, int]
    raw: pa.Array  # bytes of each id; of one that is none, nothing
    added: dict[str, int]
    cut: regex.Pattern | None
    known: Known = field(default_factory=Known)
    ranks: Ranks = field(init=False)

    def __post_init__(self) -> None:
        self.ranks = Ranks(self.pairs)

    def learn(self, texts: list[str]) -> None:
        """Ids of new words: short ones of about one length together, long ones one by one."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for text in texts:
            if text in self.added:
                self.known.add([text], np.array([self.added[text]], np.int32), np.ones(1, np.int64))
                continue
            raw = text.encode("utf-8", "replace")
            # So many bytes have pairs for one full tree.
            by_length.setdefault((1 << max(1, (len(raw) - 2).bit_length())) + 1, []).append((text, raw))
        for most, group in ((n, g[i : i + TOGETHER]) for n, g in by_length.items() for i in range(0, len(g), TOGETHER)):
            if most > LONGEST_TOGETHER:
                for text, raw in group:
                    ids = merged(self.of_byte[np.frombuffer(raw, np.uint8)].tolist(), self.pairs)
                    self.known.add([text], np.array(ids, np.int32), np.array([len(ids)]))
                continue
            sizes = np.array([len(raw) for _, raw in group])
            ids = np.full((len(group), most), -1, np.int32)
            ids[np.arange(most) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join([raw for _, raw in group]), np.uint8)]
            ids = merged_words(np.ascontiguousarray(ids.T), self.ranks).T
            self.known.add([text for text, _ in group], ids[ids >= 0], (ids >= 0).sum(1))

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, as the file's own library finds them without special tokens of its own accord, and where each text's end."""
        if len(self.known.number) > MEMO or len(self.known.flat) > MEMO_IDS:
            self.known = Known()
        tokens: list[str] = []
        sizes = []
        for text in texts:
            before = len(tokens)
            for part in self.cut.split(text) if self.cut else (text,):
                if part in self.added:
                    tokens.append(part)
                else:
                    tokens += words(part)
            sizes.append(len(tokens) - before)
        self.learn(list(set(tokens).difference(self.known.number)))
        which = np.fromiter(map(self.known.number.__getitem__, tokens), np.int64, len(tokens))
        flat, ends = gathered(self.known.flat, self.known.counts, which)
        return flat, np.concatenate([[0], ends])[np.cumsum(sizes, dtype=np.int64)]

    def ids(self, text: str) -> list[int]:
        return self.ids_of([text])[0].tolist()

    def texts(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The bytes of the ids of each text, as text; ids the file doesn't know stand for nothing, broken UTF-8 for U+FFFD."""
        # One place more in front, so that ids from -1 on name a place.
        at = np.clip(ids.to_numpy(zero_copy_only=False).astype(np.int64), -1, len(self.raw) - 1) + 1
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        parts = pa.ListArray.from_arrays(offsets, pa.concat_arrays([self.raw[-1:], self.raw]).take(pa.array(at)))
        joined = pc.binary_join(parts, pa.scalar(b"", self.raw.type))
        try:
            return joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())

    def text(self, ids: list[int]) -> str:
        return self.texts(pa.array(ids, pa.int32()), np.array([len(ids)]))[0].as_py()


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a byte-level BPE file; anything such a file may ask for beyond that raises ValueError."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file["added_tokens"]
    cutter = file["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and file["normalizer"] is None
        and (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex", True)) == ("ByteLevel", False, True)
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    vocab: dict[str, int] = model["vocab"]
    signs = byte_signs()
    byte_of = {s: b for b, s in enumerate(signs)}
    pairs: dict[int, int] = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault(vocab[left] << BITS | vocab[right], rank << BITS | vocab[left + right])
    bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
    tokens = {t["content"]: t["id"] for t in added}
    bytes_of |= {i: token.encode() for token, i in tokens.items()}
    # The last place is for ids beyond the vocabulary.
    raw = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of) + 2)], pa.large_binary())
    longest_first = sorted(tokens, key=len, reverse=True)
    cut = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})") if tokens else None
    return Vocabulary(np.array([vocab[s] for s in signs], np.int64), pairs, raw, tokens, cut)


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (array of int).

    ``path`` names the file on every machine.  A null or empty text has no ids.
    Rows, repeated ones too, pass through with all their columns; the new
    column gets underscores while its name is taken.  A text is worked on whole
    and alone, whatever its length.  An empty table stays empty.
    """
    prepared(docs.sparkSession)
    (name,) = fresh(docs, ids_col)

    def values(texts: list[bytes]) -> list[pa.Array]:
        flat, ends = load(path).ids_of([t.decode("utf-8", "replace") for t in texts])
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))]

    field_ = T.StructField(name, T.ArrayType(T.IntegerType()))
    return append_columns(docs, text_col, [field_], values)


def decoded(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids, added tokens included; a null or empty list gives an empty text."""
    prepared(docs.sparkSession)
    (name,) = fresh(docs, text_col)
    at = docs.columns.index(ids_col)

    def batches(stream):
        vocabulary = load(path)
        for batch in stream:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            texts = vocabulary.texts(pc.fill_null(batch.column(at).flatten(), -1), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))
