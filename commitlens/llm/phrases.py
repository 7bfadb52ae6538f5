"""Frequent phrases and their collocation scores, per language, by SON partitioning.

A phrase with ``support`` occurrences has, in at least one shard of the corpus,
its share of them: with shares that sum to one it can't be below its share in
every shard.  So the work has two passes over the texts:

1. Each shard (a hash class of texts, a fixed number of them) is mined completely
   at its share of the support.  A shard is no task: the splits of the input name
   every phrase by a hash of slice and 32 bits, keep equal names together and
   send each slice of names to one task, which counts it shard by shard.  The
   number of slices follows the input, so a slice is bounded and so is the chance
   that two of its names are equal.  Names of locally frequent phrases of all
   shards are united in a bitmap of fixed size.
2. Phrases whose name is in the bitmap are counted exactly, by their words.
   Equal names and shared bits only add candidates, which the exact count
   removes; no frequent phrase is ever lost.

The bitmap is the only thing that is broadcast, and has the size the caller says.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import binary, cut, prepared

#: Bits of a word's number in the codes of a task; with more words the task starts anew.
WORD_BITS = 21
#: Text bytes a slice of names stands for (a few million names).
SLICE_BYTES = 8 << 20
#: Texts are cut between pieces after so many bytes.
CHUNK = 4 << 20
END = b"\xff"  # between pieces; no byte of UTF-8
TO_ENDS = bytes.maketrans(b".,;:!?\n\v\f\r\t", END * 10 + b" ")


@dataclass(frozen=True)
class Mining:
    """``support``: least occurrences; ``longest``: words of a phrase, 2 or 3; ``absorbed``: per cent of a phrase's
    occurrences within one longer phrase that drop it; ``top``: phrases per language; ``shards``: of the first pass;
    ``bits``: of the bitmap of candidates (2 ** 27 are 16 MB); ``held``: names or codes a task holds before it sends them on."""

    support: int = 10
    longest: int = 3
    absorbed: int = 50
    top: int = 2000
    shards: int = 4
    bits: int = 1 << 27
    held: int = 1 << 22


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words of a text with END after every piece; a long text in several lists, cut between pieces."""
    text = text.lower().translate(TO_ENDS)
    start = 0
    while start < len(text):
        stop = text.find(END, start + CHUNK) if len(text) - start > CHUNK else -1
        stop = len(text) if stop < 0 else stop
        yield [*text[start:stop].replace(END, b" \xff ").split(), END]
        start = stop


class Words:
    """Numbers of the words of a task from 1 on (0: end of a piece), and their hashes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {END: 0}
        self.hashes = np.zeros(1 << 12, np.uint64)

    def full(self, more: int) -> bool:
        return len(self.number) + more >= 1 << WORD_BITS

    def numbers(self, found: list[bytes]) -> np.ndarray:
        for word in set(found).difference(self.number):
            k = len(self.number)
            if k == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
            self.number[word], self.hashes[k] = k, xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _names(ids: np.ndarray, words: Words, seeds: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: (words, places where such a phrase starts, its hashes)."""
    own = words.hashes[ids]
    inside = ids > 0
    name, whole = _mixed(own + seeds), inside
    yield 1, np.flatnonzero(whole), name[whole]
    for k in range(2, longest + 1):
        whole = whole[:-1] & inside[k - 1 :]
        name = _mixed(name[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :])
        at = np.flatnonzero(whole)
        yield k, at, name[at]


def _batches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[bytes], list[str], list[int], list[int]]]:
    """Words of many texts at once, with language, shard and number of words of each part."""
    found, langs, shards, sizes = [], [], [], []
    columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2))
    for lang, shard, text in zip(*columns, strict=True):
        for part in tokens(text):
            found += part
            langs.append(lang)
            shards.append(shard)
            sizes.append(len(part))
            if len(found) > most:
                yield found, langs, shards, sizes
                found, langs, shards, sizes = [], [], [], []
    if found:
        yield found, langs, shards, sizes


def _seeds(langs: list[str], sizes: list[int]) -> np.ndarray:
    return np.repeat(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in langs], np.uint64), sizes)


def _slots(names: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice and 32-bit name in it."""
    return (names >> np.uint64(32)) % np.uint64(slices), names & np.uint64(0xFFFFFFFF)


def _sent(docs: DataFrame, slices: int, mining: Mining) -> DataFrame:
    """(slice, shard, names): sorted 32-bit names, each at most ``support`` times."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        place = np.arange(len(keys)) - np.repeat(first, np.diff([*first, len(keys)]))
        keys = keys[place < mining.support]
        groups = keys >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        low = keys.astype(np.uint32)
        blobs = [low[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        shard, part = np.divmod(groups[starts].astype(np.int64), slices)
        return pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(shard.astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "shard", "names"]
        )

    def run(stream):
        words, held, size = Words(), [], 0
        for batch in stream:
            for found, langs, shards, sizes in _batches(batch, mining.held // 8):
                if words.full(len(found)):
                    words.clear()
                of_shard = np.repeat(np.array(shards, np.uint64), sizes)
                for _, at, names in _names(words.numbers(found), words, _seeds(langs, sizes), mining.longest):
                    part, low = _slots(names, slices)
                    held.append((of_shard[at] * np.uint64(slices) + part) << np.uint64(32) | low)
                    size += len(at)
                if size > mining.held:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return docs.mapInArrow(run, "slice long, shard int, names binary")


def _locally_frequent(sent: DataFrame, slices: int, least: dict[int, int], bits: int) -> np.ndarray:
    """Bitmap of the names that are frequent in some shard; ``least`` is each shard's support."""
    width = bits // slices

    def mined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = np.zeros(width + 8, bool)
        shards = table.column("shard").to_numpy()
        names = binary(table.column("names"))
        for shard in set(shards.tolist()):
            own = np.sort(np.concatenate([np.frombuffer(names[i], np.uint32) for i in np.flatnonzero(shards == shard)]))
            # The name at i is frequent if the one that many places on is still the same.
            step = least[shard] - 1
            often = own if not step else own[:-step][own[step:] == own[:-step]]
            found[_bit(often.astype(np.uint64), width)] = True
        packed = zlib.compress(np.packbits(found[:width], bitorder="little").tobytes(), 1)
        return pa.table({"slice": [key[0].as_py()], "bitmap": pa.array([packed], pa.binary())})

    regions = sent.groupBy("slice").applyInArrow(mined, "slice long, bitmap binary").toArrow()
    bitmap = np.zeros(slices * (-(-width // 8)), np.uint8)
    for part, packed in zip(regions.column(0).to_pylist(), regions.column(1).to_pylist(), strict=True):
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
        bitmap[part * len(raw) : (part + 1) * len(raw)] = raw
    return bitmap


def _bit(low: np.ndarray, width: int) -> np.ndarray:
    """Place of a 32-bit name within the bits of its slice."""
    return (low * np.uint64(width)) >> np.uint64(32)


def _counted(docs: DataFrame, slices: int, bitmap: bytes, mining: Mining) -> DataFrame:
    """(lang, k, phrase, c) of the candidates of a split, and its number of words (k = 0)."""
    width = mining.bits // slices
    stride = np.uint64(8 * -(-width // 8))
    mask = (1 << WORD_BITS) - 1

    def run(stream):
        known = np.frombuffer(zlib.decompress(bitmap), np.uint8)
        words, held, size = Words(), defaultdict(list), 0
        totals: dict[str, int] = defaultdict(int)

        def rows():
            vocabulary = pa.array(list(words.number), pa.binary())
            for (lang, k), codes in held.items():
                code, count = np.unique(np.concatenate(codes), return_counts=True)
                parts = [vocabulary.take(pa.array(code >> (WORD_BITS * j) & mask)) for j in reversed(range(k))]
                phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code)), pa.array(np.full(len(code), k, np.int32)), phrases, pa.array(count)],
                    names=["lang", "k", "phrase", "c"],
                )
            held.clear()

        for batch in stream:
            for found, langs, _, sizes in _batches(batch, mining.held // 8):
                if size > mining.held or words.full(len(found)):
                    yield from rows()
                    size = 0
                    if words.full(len(found)):
                        words.clear()
                ids = words.numbers(found)
                kinds = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                of_lang = np.repeat(np.array([kinds[x] for x in langs]), sizes)
                for lang, n in zip(kinds, np.bincount(of_lang[ids > 0], minlength=len(kinds)).tolist(), strict=True):
                    totals[lang] += n
                for k, at, names in _names(ids, words, _seeds(langs, sizes), mining.longest):
                    part, low = _slots(names, slices)
                    bit = part * stride + _bit(low, width)
                    at = at[(known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    code = ids[at]
                    for j in range(1, k):
                        code = code << WORD_BITS | ids[at + j]
                    own = of_lang[at]
                    for lang, i in kinds.items():
                        if len(hit := code[own == i] if len(kinds) > 1 else code):
                            held[lang, k].append(hit)
                            size += len(hit)
        yield from rows()
        if totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals)), pa.array([0] * n, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array(list(totals.values()), pa.int64())],
                names=["lang", "k", "phrase", "c"],
            )

    return docs.mapInArrow(run, "lang string, k int, phrase binary, c long")


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", mining: Mining = Mining()) -> DataFrame:
    """(lang, k, phrase, a): every phrase of k words with ``support`` or more occurrences, exactly counted.

    Rows with k = 0 hold the number of words of each language.  The text phrase
    is bytes here, as it is compared bytewise.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(text_col), F.lit(mining.shards)).cast("int").alias("shard"),
        F.col(text_col).alias("text"),
    )
    shares = {r.shard: r.size for r in texts.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    total = sum(shares.values())
    if not total:
        return spark.createDataFrame([], "lang string, k int, phrase binary, a long")
    least = {k: max(1, -(-mining.support * size // total)) for k, size in shares.items()}
    slices = max(1, total // SLICE_BYTES)
    bitmap = _locally_frequent(_sent(texts, slices, mining), slices, least, mining.bits)
    counted = _counted(texts, slices, zlib.compress(bitmap.tobytes(), 1), mining)
    found = counted.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("a"))
    return cut(found.where((F.col("k") == 0) | (F.col("a") >= mining.support)), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", mining: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    Words are lower-case (A-Z); marks ``.,;:!?`` and line ends cut a text into
    pieces that no phrase crosses.  Null texts and texts without words count
    nothing; a null language is ``und``, as are rows that say so; repeated rows
    count each time.  Texts count whole, whatever their length (one piece of a
    text must fit in a task).  An empty table, and a language without frequent
    phrases, give no rows.  Ties in score and ``a`` go by the bytes of the phrase.
    Other columns of ``docs`` don't matter, whatever their names.
    """
    if mining.longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    if mining.bits < mining.shards:
        raise ValueError("the bitmap is too small")
    found = counts(docs, text_col, lang_col, mining)
    exact = "decimal(20,0)"
    part = found.where("k > 0").select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    candidates = found.where("k > 1").withColumn("w", F.split(F.col("phrase").cast("string"), " "))

    def joined(first, size) -> F.Column:
        return F.array_join(F.slice("w", first, size), " ").cast("binary")

    cuts = [F.struct(F.lit(c).alias("cut"), joined(1, F.lit(c)).alias("left"), joined(c + 1, F.col("k") - c).alias("right")) for c in range(1, mining.longest)]
    pairs = candidates.select("lang", "phrase", "k", "a", F.explode(F.filter(F.array(*cuts), lambda c: c["cut"] < F.col("k"))).alias("c"))
    for side in ("left", "right"):
        pairs = pairs.join(
            part.withColumnRenamed("f", side[0]), (F.col("lang") == F.col("part_lang")) & (F.col(f"c.{side}") == F.col("part"))
        ).drop("part_lang", "part")
    a, left, right = (F.col(x).cast(exact) for x in "alr")
    scored = pairs.withColumn("_square", a * a * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("_parts", left * right)
    scored = scored.withColumn("score", F.expr("_square div _parts"))
    # Score and cut in one number: of the lowest scores the first cut.
    lowest = scored.groupBy("lang", "phrase", "k", "a").agg(
        F.min(F.col("score") * 4 + F.col("c.cut")).alias("low"),
        *[F.max(F.when(F.col("c.cut") == c, F.col(x))).alias(f"{x}{c}") for c in range(1, mining.longest) for x in "lr"],
    )
    chosen = [
        F.coalesce(*[F.when(F.col("low") % 4 == c, F.col(f"{x}{c}")) for c in range(1, mining.longest)]).alias(x) for x in "lr"
    ]
    best = lowest.select("lang", "phrase", "k", "a", *chosen, F.floor(F.col("low") / 4).cast("long").alias("score"))
    if mining.longest > 2:
        longer = candidates.where("k = 3").select("lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("inner"), "a")
        longer = longer.groupBy(F.col("lang").alias("in_lang"), "inner").agg(F.max("a").alias("most"))
        best = best.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")), "left").where(
            F.coalesce(100 * F.col("most") < mining.absorbed * F.col("a"), F.lit(True))
        )
    best = best.select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: the best of each slice first, then the best of these.
    sliced = best.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "_slice"], ["lang"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(
            F.col("rank") <= mining.top
        )
    sizes = found.where("k = 0").select(F.col("lang").alias("of_lang"), F.col("a").alias("n"))
    return sliced.join(sizes, F.col("lang") == F.col("of_lang")).select(
        "lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"
    )
