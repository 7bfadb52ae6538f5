"""Repeated passages by relative Lempel-Ziv parsing.

A passage is a run of words that also starts elsewhere.  In every window of
``window`` words the k-gram with the smallest hash is its anchor; equal windows
have equal anchors at equal places, so both lie around an anchor the corpus has
twice.  The words around such anchors go to reference blocks by the anchor's
hash: a window can only be found in the block of its anchor.

A block is indexed by a suffix array (prefix doubling), which gives the longest
match of every position with any other.  Each text is factored greedily against
the block: a factor is the longest match from its start.  A factor of a window
or more is a repeated span.  A repeated window that no factor holds crosses one
factor boundary only (the factor that starts inside it must reach its end), so
two adjacent factors are checked if together they are long enough.

Anchors with very many places would make a block too large; their windows are
counted by hash instead.  Equal texts are parsed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import binary, cut, fresh, prepared


@dataclass(frozen=True)
class Parsing:
    """``window`` words make a passage, ``gram`` an anchor; ``block`` words are about the size of a block.

    An anchor with more than ``crowd`` places is counted by windows; results do
    not depend on ``gram``, ``block`` and ``crowd``.
    """

    window: int = 35
    gram: int = 8
    block: int = 1 << 18
    crowd: int = 512


BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size if n > 0 else 0):
            out = out * BASE + hashes[i : i + n]
        out ^= out >> np.uint64(32)
        out *= MIX
        out ^= out >> np.uint64(29)
    return out


def anchors(hashes: np.ndarray, p: Parsing) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for every window, and the k-gram hashes; no window in a short text."""
    if len(hashes) < p.window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = rolling(hashes, p.gram)
    width = p.window - p.gram + 1
    out = np.empty(len(grams) - width + 1, np.int64)
    for at in range(0, len(out), 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + width - 1], width)
        out[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    return out, grams


def _longs(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def marked(docs: DataFrame, text_col: str, p: Parsing) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n_words, tid (128 bits of the word sequence), anchor hashes and places."""
    names = dict(zip(["n_words", "tid", "anchors", "places"], fresh(docs, "n_words", "_tid", "_anchors", "_places"), strict=True))
    at = docs.columns.index(text_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            count, tid, found, places = [], [], [], []
            for text in binary(batch.column(at)):
                words = text.split()
                count.append(len(words))
                tid.append(hashlib.sha256(b" ".join(words)).digest()[:16])
                place, grams = anchors(word_hashes(words), p)
                place = np.unique(place)
                found.append(_longs(grams[place]))
                places.append(place.astype(np.int32))
            columns = [pa.array(count, pa.int64()), pa.array(tid, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names.values()])

    kinds = [T.LongType(), T.BinaryType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())]
    more = [T.StructField(n, k) for n, k in zip(names.values(), kinds, strict=True)]
    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *more])), names


def _ranges(text: bytes, places: list[dict], p: Parsing) -> Iterator[tuple[np.ndarray, int, int, int, bool]]:
    """(word hashes, gram hash, first window, last window, crowded) for every shared place."""
    hashes = word_hashes(text.split())
    owner, grams = anchors(hashes, p)
    for x in places:
        low, high = np.searchsorted(owner, x["place"], "left"), np.searchsorted(owner, x["place"], "right")
        yield hashes, int(_longs(grams[x["place"] : x["place"] + 1])[0]), int(low), int(high) - 1, x["crowded"]


def contexts(shared: DataFrame, blocks: int, p: Parsing) -> DataFrame:
    """(block, tid, start, words): stretches of a text for the blocks of its anchors, without overlap in a block."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            block, tid, start, words = [], [], [], []
            for key, text, places in zip(batch.column(0).to_pylist(), binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                by: dict[int, list[list[int]]] = {}
                hashes = np.zeros(0, np.uint64)
                for hashes, gram, low, high, crowded in _ranges(text, sorted(places, key=lambda x: x["place"]), p):
                    if not crowded:
                        runs = by.setdefault(gram % blocks, [])
                        if runs and runs[-1][1] >= low:
                            runs[-1][1] = max(runs[-1][1], high + p.window)
                        else:
                            runs.append([low, high + p.window])
                for b, runs in by.items():
                    for low, high in runs:
                        block.append(b)
                        tid.append(key)
                        start.append(low)
                        words.append(hashes[low:high].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(tid, pa.binary()), pa.array(start, pa.int32()), pa.array(words, pa.binary())],
                names=["block", "tid", "start", "words"],
            )

    return shared.mapInArrow(batches, "block long, tid binary, start int, words binary")


def crowded_windows(shared: DataFrame, p: Parsing) -> DataFrame:
    """(window, tid, start): the windows of crowded anchors by their hash."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            window, tid, start = [], [], []
            for key, text, places in zip(batch.column(0).to_pylist(), binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                every = None
                for hashes, _, low, high, crowded in _ranges(text, [x for x in places if x["crowded"]], p):
                    every = rolling(hashes, p.window) if every is None else every
                    window.append(_longs(every[low : high + 1]))
                    start.append(np.arange(low, high + 1, dtype=np.int32))
                    tid += [key] * (high + 1 - low)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(window or none)), pa.array(tid, pa.binary()), pa.array(np.concatenate(start or none).astype(np.int32))],
                names=["window", "tid", "start"],
            )

    return shared.mapInArrow(batches, "window long, tid binary, start int")


def longest_matches(segments: list[np.ndarray], most: int) -> np.ndarray:
    """For each position of the segments, one after the other, its longest match with another position, up to ``most``.

    Prefix doubling ranks all suffixes; neighbours in rank order share the
    longest prefixes, whose lengths come from the ranks of each doubling.  A match
    does not run over the end of a segment.
    """
    lengths = np.array([len(s) for s in segments])
    n = int(lengths.sum())
    _, rank = np.unique(np.concatenate(segments), return_inverse=True)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # words up to the segment's end
    own = np.arange(n, dtype=np.int64)
    ranks, size = [rank.astype(np.int64)], 1
    while size < most:
        last = ranks[-1]
        # Beyond an end every position has a rank of its own, so it matches nothing.
        ahead = np.where(left > size, last[np.minimum(own + size, n - 1)], -1 - own)
        _, joined = np.unique(last * (2 * n + 2) + (ahead + n + 1), return_inverse=True)
        ranks.append(joined.astype(np.int64))
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(max(n - 1, 0), np.int64)
    for step in range(len(ranks) - 1, -1, -1):
        add = 1 << step
        fits = (left[a] - shared >= add) & (left[b] - shared >= add)
        same = ranks[step][np.minimum(a + shared, n - 1)] == ranks[step][np.minimum(b + shared, n - 1)]
        shared += np.where(fits & same, add, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return np.minimum(out, left)


def parse(match: np.ndarray, window: int) -> np.ndarray:
    """Whether each word of one segment lies in a repeated window, by greedy factors and their boundaries."""
    n = len(match)
    change = np.zeros(n + 1, np.int64)
    steps, before, at = match.tolist(), 0, 0
    while at < n:
        end = at + max(steps[at], 1)
        if end - at >= window:
            change[at] += 1
            change[end] -= 1
        if at and end - before >= window:
            # Windows that start in the factor before and end in this one.
            low, high = max(before, at - window + 1), min(at, end - window + 1)
            for j in np.flatnonzero(match[low:high] >= window) + low if high > low else ():
                change[j] += 1
                change[j + window] -= 1
        before, at = at, end
    return np.cumsum(change[:n]) > 0


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def factored(blocks: DataFrame, p: Parsing) -> DataFrame:
    """(tid, low, high): repeated spans of words found within blocks."""

    def one_block(table: pa.Table) -> pa.Table:
        segments = [np.frombuffer(w, np.uint64) for w in table["words"].to_pylist()]
        tids, starts, found = table["tid"].to_pylist(), table["start"].to_pylist(), []
        match, at = longest_matches(segments, 2 * p.window), 0
        for tid, start, segment in zip(tids, starts, segments, strict=True):
            for low, high in spans_of(parse(match[at : at + len(segment)], p.window)):
                found.append((tid, start + low, start + high))
            at += len(segment)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table(
            {"tid": pa.array(columns[0], pa.binary()), "low": pa.array(columns[1], pa.int32()), "high": pa.array(columns[2], pa.int32())}
        )

    return blocks.groupBy("block").applyInArrow(one_block, "tid binary, low int, high int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parsing: Parsing | None = None) -> DataFrame:
    """``docs`` with n_words and spans (low, high) of the words that lie in repeated windows, appended last.

    A window counts if its words also start anywhere else, in the same or another
    row.  Spans are sorted and do not overlap.  A null, empty or short text has
    none; in equal texts of a window or more all words are repeated.  An empty
    table gives none.  New columns whose names ``docs`` already has get an
    underscore.
    """
    p = parsing or Parsing()
    prepared(docs.sparkSession)
    rows, names = marked(docs, text_col, p)
    rows = cut(rows, "marked")
    tid, n_words = names["tid"], names["n_words"]
    long = rows.filter(F.col(n_words) >= p.window)
    first = cut(long.groupBy(F.col(tid).alias("tid")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")), "texts")
    owners = long.join(first, (F.col(tid) == F.col("tid")) & F.col(id_col).eqNullSafe(F.col("first_id")))
    each = F.explode(F.arrays_zip(F.col(names["anchors"]).alias("anchor"), F.col(names["places"]).alias("place")))
    one = owners.select("tid", names["anchors"], names["places"]).dropDuplicates(["tid"])
    seeds = cut(one.select("tid", each.alias("e")).select("tid", F.col("e.anchor").alias("anchor"), F.col("e.place").alias("place")), "anchors")
    # Written, so that the join reads plain exchanges on both sides, which can be split where an anchor is crowded.
    twice = cut(seeds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    shared = seeds.join(twice, "anchor").select("tid", F.struct("place", (F.col("n") > p.crowd).alias("crowded")).alias("place"))
    shared = cut(shared.groupBy("tid").agg(F.collect_list("place").alias("places")), "shared")
    total = shared.agg(F.sum(F.size("places"))).first()[0] or 0
    texts = owners.select("tid", F.col(text_col).alias("text")).join(shared, "tid").dropDuplicates(["tid"])
    texts = cut(texts.select("tid", "text", "places"), "shared-texts")
    number = max(1, -(-total * 2 * p.window // p.block))
    spans = factored(contexts(texts, number, p), p)
    windows = cut(crowded_windows(texts, p), "windows")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    windows = windows.join(again, "window").select("tid", F.col("start").alias("low"), (F.col("start") + p.window).alias("high"))
    spans = spans.union(windows).groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    facts = first.join(spans, "tid", "left").select(F.col("tid").alias("tid_of_facts"), "copies", "found")
    facts = cut(facts.filter("copies > 1 OR found IS NOT NULL"), "spans")
    (out,) = fresh(rows, "spans")
    joined = rows.join(facts, F.col(tid) == F.col("tid_of_facts"), "left")
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col(n_words).cast("int").alias("high")))
    none = F.array().cast("array<struct<low:int,high:int>>")
    found = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("found", none))
    return _united(joined.select(*docs.columns, n_words, found.alias(out)), out)


def _united(df: DataFrame, spans_col: str) -> DataFrame:
    """``df`` with spans sorted, and those that touch or overlap made one."""
    at = df.columns.index(spans_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            every = []
            for spans in batch.column(at).to_pylist():
                one: list[list[int]] = []
                for low, high in sorted((s["low"], s["high"]) for s in spans):
                    if one and one[-1][1] >= low:
                        one[-1][1] = max(one[-1][1], high)
                    else:
                        one.append([low, high])
                every.append([{"low": low, "high": high} for low, high in one])
            columns = list(batch.columns)
            columns[at] = pa.array(every, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(batches, df.schema)


def without_spans(df: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """``df`` with kept_text, the words outside the spans joined by one space, and n_removed, appended last."""
    kept, removed = fresh(df, "kept_text", "n_removed")
    at, spans_at = df.columns.index(text_col), df.columns.index(spans_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts, counts = [], []
            for text, spans in zip(binary(batch.column(at)), batch.column(spans_at).to_pylist(), strict=True):
                words, left, done = text.split(), [], 0
                for s in spans:
                    left += words[done : s["low"]]
                    done = s["high"]
                left += words[done:]
                texts.append(b" ".join(left))
                counts.append(len(words) - len(left))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, kept, removed])

    more = [T.StructField(kept, T.StringType()), T.StructField(removed, T.LongType())]
    return df.mapInArrow(batches, T.StructType([*df.schema.fields, *more]))
