"""N-best segmentation of texts into SentencePiece pieces.

The lattice of a text has a node for each character and an edge for each piece.
No piece runs over the start of a word, so the lattice is a chain of word
lattices.  Forward Viterbi scores of a word give its best pieces; they are also
the exact heuristic of an A-star search that goes backward through the lattice
and meets its paths from the best down.

A path among the N best can only leave the best path in the N - 1 words whose
second path costs least (leaving it in another word costs at least as much as
each of these alone), so the search runs over the lattice of these words and the
rest stays as it is.  What a word's second path costs comes from forward and
backward scores: the best path over any edge that is not on the best path.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from commitlens.llm.common import fresh, prepared

MARK = "▁"  # stands for a space in pieces
#: As in SentencePiece: an unknown character scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words kept with their best pieces; the memo is emptied when it is full.
MEMO = 1 << 19
#: Searches kept with their paths; this memo is emptied when it is full, too.
SEARCHES = 1 << 15
#: Hashes of pieces are looked up by so many of their bits first.
TOP_BITS = 20
#: Rows times width of one vectorised lattice.
CELLS = 1 << 16
LOW = -np.inf
GONE = -(1 << 30)


@dataclass
class Known:
    """Pieces of memoised words one after the other, with numbers of pieces, scores and gaps."""

    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gap: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self.start = np.cumsum(self.count) - self.count


@dataclass
class Model:
    """Pieces and scores of a model file, and a memo of words."""

    ids: dict[str, int]
    scores: np.ndarray
    raw: list[bytes]  # what a piece stands for
    byte_ids: list[int]
    dummy_prefix: bool
    longest: int
    unknown: float
    words: re.Pattern
    hashes: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)
    flat_raw: pa.Array = field(init=False)
    memo: dict[str, int] = field(default_factory=dict)
    known: Known = field(default_factory=Known)
    searches: dict[tuple, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys = list(self.ids)
        known = np.array([poly(codes([k], len(k))[0])[-1] for k in keys], np.uint64)
        by = np.argsort(known, kind="stable")
        self.hashes, self.order = known[by], np.array([self.ids[k] for k in keys], np.int64)[by]
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << TOP_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - TOP_BITS)] = True
        self.flat_raw = pa.array(self.raw, pa.large_binary())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Pieces of hashes, -1 for none; most hashes fail on their top bits alone."""
        found = np.full(hashes.shape, -1, np.int32)
        likely = np.nonzero(self.maybe[hashes >> np.uint64(64 - TOP_BITS)])
        asked = hashes[likely]
        place = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        found[likely] = np.where(self.hashes[place] == asked, self.order[place], -1)
        return found


BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list[str], width: int) -> np.ndarray:
    flat = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, "<u4").reshape(len(texts), width).astype(np.uint64)


def poly(row: np.ndarray) -> np.ndarray:
    """Rolling hash of every prefix, along the last axis."""
    out = np.zeros((*row.shape[:-1], row.shape[-1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(row.shape[-1]):
            out[..., i + 1] = out[..., i] * BASE + row[..., i] + np.uint64(1)
    return out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, raw, byte_ids = {}, [], [-1] * 256
    scores = np.array([sp.get_score(i) for i in range(sp.vocab_size())])
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            ids[piece] = i
            raw.append(piece.replace(MARK, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError("a model with byte fallback is needed")
    # A text is cut before each run of spaces, and around line feeds, where no piece runs over the cut.
    whole = [p for p in ids if re.search(f"[^{MARK}]{MARK}", p)]
    feeds = any("\n" in p and len(p) > 1 for p in ids)
    pattern = "[\\s\\S]+" if whole else f"{MARK}+|{MARK}*[^{MARK}]+" if feeds else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"
    probe = sp.encode("a")
    return Model(
        ids=ids,
        scores=scores,
        raw=raw,
        byte_ids=byte_ids,
        dummy_prefix=sp.id_to_piece(probe[0]).startswith(MARK),
        longest=max(map(len, ids)),
        unknown=float(min(scores[i] for i in ids.values())) - UNKNOWN_PENALTY,
        words=re.compile(pattern),
    )


#: A literal mark in a text is not a space; it goes through the lattice as a character no piece has.
LITERAL = "\U0010fffe"


def split(model: Model, text: str) -> list[str]:
    """The text as words of its lattice, with marks for spaces."""
    marked = text.replace(MARK, LITERAL).replace(" ", MARK)
    return model.words.findall(MARK + marked if model.dummy_prefix and text else marked)


def fallback(model: Model, char: str) -> list[int]:
    char = MARK if char == LITERAL else char
    return [model.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


def learn(model: Model, words: list[str]) -> None:
    """Best pieces, best score and cost of the second path of words, into the memo."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(-(-len(w) // 4) * 4 if len(w) <= 32 else 1 << (len(w) - 1).bit_length(), []).append(w)
    parts = []
    for width, group in sorted(by.items()):
        rows, widest = max(1, CELLS // width), max(map(len, group))
        for at in range(0, len(group), rows):
            parts += _lattices(model, group[at : at + rows], widest)
    for names, *_ in parts:
        model.memo.update(zip(names, range(len(model.memo), len(model.memo) + len(names)), strict=True))
    known = model.known
    flat = np.concatenate([known.flat, *(p[1] for p in parts)]).astype(np.int32)
    count, score, gap = (np.concatenate([x, *(p[i] for p in parts)]) for i, x in ((2, known.count), (3, known.score), (4, known.gap)))
    model.known = Known(flat, count.astype(np.int64), score, gap)


def _lattices(model: Model, words: list[str], width: int) -> list[tuple]:
    """(words, pieces one after the other, numbers of pieces, scores, gaps), words of known characters first."""
    n, most = len(words), min(model.longest, width)
    length = np.fromiter(map(len, words), np.int64, n)
    prefix = np.ascontiguousarray(poly(codes(words, width)).T)
    power = np.ones(most + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(most):
            power[i + 1] = power[i] * BASE
    # Edges by (piece length from long to short, end, row), so that the edges into a node lie beside the nodes before it.
    score = np.full((most, width + 1, n), LOW)
    piece = np.full((most, width + 1, n), -1, np.int32)
    inside = np.arange(width + 1)[:, None] <= length
    for k, size in enumerate(range(most, 0, -1)):
        with np.errstate(over="ignore"):
            sub = prefix[size:] - prefix[: width + 1 - size] * power[size]
        found = np.where(inside[size:], model.find(sub), np.int32(-1))
        piece[k, size:] = found
        hit = np.nonzero(found >= 0)
        score[k, size:][hit] = model.scores[found[hit]]
    lone = (piece[most - 1] < 0) & inside
    lone[0] = False
    score[most - 1][lone] = model.unknown
    forward = np.full((width + 1, n), LOW)
    forward[0] = 0
    pick = np.zeros((width + 1, n), np.int64)
    rows = np.arange(n)
    for e in range(1, width + 1):
        m = min(most, e)
        ways = forward[e - m : e] + score[most - m :, e]
        pick[e] = ways.argmax(axis=0) + (most - m)
        forward[e] = ways.max(axis=0)
    best = forward[length, rows]
    backward = np.full((width + 1, n), LOW)
    backward[length, rows] = 0
    for e in range(width, 0, -1):
        m = min(most, e)
        np.maximum(backward[e - m : e], backward[e] + score[most - m :, e], out=backward[e - m : e])
    # The best path, backward, with its edges taken out of the lattice.
    steps, at = [], length.copy()
    while (live := at > 0).any():
        k = pick[at, rows]
        steps.append(np.where(live, np.where(piece[k, at, rows] >= 0, piece[k, at, rows], -1 - at), GONE))
        score[k[live], at[live], rows[live]] = LOW
        at = np.where(live, at - (most - k), at)
    second = np.full(n, LOW)
    for s in range(1, most + 1):
        over = forward[: width + 1 - s] + score[most - s, s:] + backward[s:]
        np.maximum(second, over.max(axis=0), out=second)
    path = np.stack(steps[::-1], axis=1)
    gap = best - second
    odd = ((path < 0) & (path > GONE)).any(axis=1)
    even = np.flatnonzero(~odd)
    used = path[even] >= 0
    parts = [([words[i] for i in even], path[even][used], used.sum(axis=1), best[even], gap[even])]
    for i in np.flatnonzero(odd).tolist():
        ids: list[int] = []
        for p in path[i].tolist():
            if p > GONE:
                ids += [p] if p >= 0 else fallback(model, words[i][-p - 2])
        parts.append(([words[i]], np.array(ids), np.array([len(ids)]), best[i : i + 1], gap[i : i + 1]))
    return parts


def search(model: Model, words: list[str], n: int) -> list[tuple[float, list[list[int]]]]:
    """The ``n`` best paths over a chain of words: (score, pieces of each word), best first.

    Backward A-star: a state is a node with the score of what follows it; its
    rank adds the forward Viterbi score of the node, which is exact.
    """
    text = "".join(words)
    starts, at = {0}, 0
    for w in words:
        at += len(w)
        starts.add(at)
    into: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
    forward = [0.0] + [LOW] * len(text)
    floor = 0
    for e in range(1, len(text) + 1):
        for s in range(e - 1, max(floor, e - model.longest) - 1, -1):
            i = model.ids.get(text[s:e])
            if i is not None:
                into[e].append((s, float(model.scores[i])))
            elif s == e - 1:
                into[e].append((s, model.unknown))
        forward[e] = max(forward[s] + c for s, c in into[e])
        if e in starts:
            floor = e
    agenda: list[tuple] = [(-forward[-1], 0, len(text), 0.0, None)]
    found, count = [], 1
    while agenda and len(found) < n:
        rank, _, node, rest, path = heapq.heappop(agenda)
        if node == 0:
            found.append((-rank, path))
            continue
        for s, c in into[node]:
            heapq.heappush(agenda, (-(forward[s] + c + rest), count, s, rest + c, (s, node, path)))
            count += 1
    out = []
    for total, path in found:
        pieces: list[list[int]] = []
        while path:
            s, e, path = path
            if s in starts:
                pieces.append([])
            i = model.ids.get(text[s:e])
            pieces[-1] += [i] if i is not None else fallback(model, text[s])
        out.append((total, pieces))
    return out


def searched(model: Model, words: tuple[str, ...], n: int) -> list[tuple[float, list[list[int]]]]:
    """``search``, with its paths kept, as texts tend to leave their best paths in the same words."""
    found = model.searches.get((n, words))
    if found is None:
        if len(model.searches) >= SEARCHES:
            model.searches.clear()
        found = model.searches[n, words] = search(model, list(words), n)
    return found


def encode(model: Model, text: str, n: int = 1) -> tuple[np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
    """Best pieces of a text, and its ``n`` best paths as (score, edits of the best pieces).

    An edit (at, drop, ids) puts ``ids`` in place of ``drop`` pieces from ``at``;
    the first path has none.
    """
    return next(encode_all(model, [text], n))


def encode_all(model: Model, texts: list[str], n: int = 1) -> Iterator[tuple[np.ndarray, list]]:
    """``encode`` of each text; new words of all texts are worked out together."""
    split_up = [split(model, t) for t in texts]
    every = set().union(*split_up)
    new = every.difference(model.memo)
    if len(model.memo) + len(new) > MEMO:
        model.memo, model.known, new = {}, Known(), every
    if new:
        learn(model, sorted(new))
    for words in split_up:
        yield _paths(model, words, n)


def _paths(model: Model, words: list[str], n: int) -> tuple[np.ndarray, list]:
    known = model.known
    place = np.fromiter(map(model.memo.__getitem__, words), np.int64, len(words))
    count = known.count[place]
    begin = np.cumsum(count) - count
    ids = known.flat[np.repeat(known.start[place] - begin, count) + np.arange(int(count.sum()))]
    total = float(known.score[place].sum())
    if n < 2 or not len(words):
        return ids, [(total, [])]
    gap = known.gap[place]
    near = np.sort(_smallest(gap, min(n - 1, len(gap))))
    near = near[np.isfinite(gap[near])]
    if not len(near):
        return ids, [(total, [])]
    fixed = total - float(known.score[place[near]].sum())
    own = [ids[begin[i] : begin[i] + count[i]].tolist() for i in near]
    paths = []
    for score, parts in searched(model, tuple(words[i] for i in near), n):
        edits = [
            (int(begin[i]), len(old), part) for i, old, part in zip(near, own, parts, strict=True) if part != old
        ]
        paths.append((fixed + score, edits))
    # Where paths tie, the first is the one the words' own lattices chose.
    paths.sort(key=lambda p: (-p[0], bool(p[1])))
    return ids, paths


def _smallest(gap: np.ndarray, few: int) -> np.ndarray:
    """Places of the smallest values, ties to the first, without a full sort."""
    edge = np.partition(gap, few - 1)[few - 1]
    below = np.flatnonzero(gap < edge)
    return np.concatenate([below, np.flatnonzero(gap == edge)[: few - len(below)]])


def apply_edits(ids, edits: list) -> list[int]:
    """The pieces of another path."""
    ids, out, at = [int(i) for i in ids], [], 0
    for place, drop, new in edits:
        out += [*ids[at:place], *new]
        at = place + drop
    return [*out, *ids[at:]]


def decode(model: Model, ids: list[int]) -> str:
    return decode_all(model, pa.array([ids], pa.list_(pa.int32())))[0]


def decode_all(model: Model, ids: pa.ListArray) -> list[str | None]:
    """Texts of lists of pieces; what the pieces stand for is laid out for all lists at once."""
    bounds = ids.offsets.to_numpy()
    first, last = int(bounds[0]), int(bounds[-1])
    spelt = model.flat_raw.take(ids.values.slice(first, last - first))
    _, ends, data = spelt.buffers()
    ends = np.frombuffer(ends, np.int64)[spelt.offset :][: len(spelt) + 1] if len(spelt) else np.zeros(1, np.int64)
    at = ends[bounds - first].tolist()
    view = memoryview(data or b"")
    texts: list[str | None] = []
    for here, low, high in zip(ids.is_valid().to_pylist(), at, at[1:], strict=False):
        text = str(view[low:high], "utf-8", "replace") if here else None
        texts.append(text[1:] if text and model.dummy_prefix and text[0] == " " else text)
    return texts


EDIT = T.StructType(
    [
        T.StructField("at", T.IntegerType()),
        T.StructField("drop", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
PATH = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(EDIT))])
_PATHS = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
        ]
    )
)


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", n: int = 4) -> DataFrame:
    """``docs`` with ids (best pieces) and paths (the n best, as edits of ids), appended last.

    A null text has null ids and paths; an empty one no pieces and one path of
    score 0.  Fewer paths come where the lattice has no more.  Equal rows give
    equal results; new columns whose names ``docs`` already has get an underscore.
    ``model_path`` must be readable on every executor.
    """
    prepared(docs.sparkSession)
    ids_name, paths_name = fresh(docs, "ids", "paths")
    at = docs.columns.index(text_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in stream:
            ids, paths = [], []
            texts = batch.column(at).to_pylist()
            found = encode_all(model, [t for t in texts if t is not None], n)
            for text in texts:
                best, ways = (None, None) if text is None else next(found)
                ids.append(best)
                paths.append(
                    None
                    if ways is None
                    else [{"score": s, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in e]} for s, e in ways]
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(paths, _PATHS)],
                names=[*batch.schema.names, ids_name, paths_name],
            )

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField(ids_name, T.ArrayType(T.IntegerType())),
            T.StructField(paths_name, T.ArrayType(PATH)),
        ]
    )
    return docs.mapInArrow(batches, schema)


def decoded(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with the text its pieces stand for, appended as ``decoded``; null ids give null."""
    prepared(df.sparkSession)
    (name,) = fresh(df, "decoded")
    at = df.columns.index(ids_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in stream:
            texts = decode_all(model, batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
            )

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
