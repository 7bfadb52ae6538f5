"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints that differ in at most
``distance`` bits differ in few bits of some segment, so it is enough to look
up, segment by segment, the keys in a small Hamming ball around a segment and
to verify the distance of what is met.

Work is done on distinct fingerprints: a group of copies, however large, is one
row.  Fingerprints of one segment key are first tied to the smallest of them
where the distance allows it, so the ball lookups only compare fingerprints that
are not yet in one component, and no pairs within a group come out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import append_columns, connected, cut, fresh, prepared

SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        start = end - length
        last = len(words) - shingle + 1
        pairs = zip(start[:last].tolist(), end[shingle - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs]
    ones = np.zeros(BITS, np.int64)
    every = np.array(hashes, dtype="<u8")
    for at in range(0, len(every), 1 << 14):
        part = every[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> tuple[DataFrame, str]:
    """``docs`` with a fingerprint (long) in a column whose name is returned too."""
    (name,) = fresh(docs, "fingerprint")

    def values(texts: list[bytes]) -> list:
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return [pa.array(found.view(np.int64))]

    return append_columns(docs, text_col, [T.StructField(name, T.LongType())], values), name


def segment_plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment.

    With distance = segments * r + a, either one of the first a + 1 segments
    differs in at most r bits or one of the rest in at most r - 1: else the
    bits would add up to more than the distance.
    """
    if not 1 <= segments <= BITS or distance < 0:
        raise ValueError("segments must be 1 to 64 and distance not negative")
    r, a = divmod(distance, segments)
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [
        (low, high - low, radius)
        for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))
        if (radius := r if i <= a else r - 1) >= 0
    ]


def ball(bits: int, radius: int) -> list[int]:
    """Masks of all changes of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(bits), n)]


def _segment(name: str, low: int, bits: int):
    return F.shiftrightunsigned(name, low).bitwiseAND(F.lit((1 << bits) - 1))


def fingerprint_links(prints: DataFrame, distance: int, segments: int) -> DataFrame:
    """(a, b) links over distinct ``prints`` (fp) whose components are those of all pairs within ``distance``."""
    plan = segment_plan(distance, segments)
    table = prints.select(
        "fp",
        F.posexplode(F.array(*(_segment("fp", low, bits) for low, bits, _ in plan))).alias("segment", "key"),
    )
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    # Spark takes a table for as small as before its explode, so joins of what is exploded are never left to broadcasts.

    # Within one key: to the smallest fingerprint, where that is near enough.
    centre = table.groupBy("segment", "key").agg(F.min("fp").alias("centre"), F.max("fp").alias("other"))
    # Written, so that the join reads plain exchanges on both sides, which can be split where a key is crowded.
    centre = cut(centre.filter("centre != other").drop("other"), "centres")
    stars = table.hint("merge").join(centre, ["segment", "key"]).filter((F.col("fp") != F.col("centre")) & near("fp", "centre"))
    stars = cut(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    roots = connected(stars).withColumnRenamed("node", "fp")

    # Balls: only between fingerprints that are not yet tied together.
    known = cut(
        prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "tied"
    )
    keys = F.array(*(_segment("fp", low, bits) for low, bits, _ in plan))
    held = known.select("fp", "root", F.posexplode(keys).alias("segment", "key"))
    masks = F.array(
        *(F.array(*(F.lit(m).cast("long") for m in ball(bits, radius))) for _, bits, radius in plan)
    )
    probes = known.select("fp", "root", F.posexplode(keys).alias("segment", "own")).select(
        F.col("fp").alias("fp_p"),
        F.col("root").alias("root_p"),
        F.col("segment").alias("segment_p"),
        "own",
        F.explode(masks[F.col("segment")]).alias("mask"),
    )
    probes = probes.select("fp_p", "root_p", "segment_p", F.col("own").bitwiseXOR(F.col("mask")).alias("key_p"))
    met = probes.hint("merge").join(
        held.hint("merge"),
        (F.col("segment") == F.col("segment_p"))
        & (F.col("key") == F.col("key_p"))
        & (F.col("fp_p") < F.col("fp"))
        & (F.col("root_p") != F.col("root"))
        & near("fp_p", "fp"),
    )
    met = met.select(F.least("root_p", "root").alias("a"), F.greatest("root_p", "root").alias("b"))
    return stars.union(met.distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    distance: int = 4,
    segments: int = 3,
) -> DataFrame:
    """``docs`` with fingerprint, group and component_id, in columns appended last.

    Fingerprints within ``distance`` bits are linked; a component is what links
    reach.  ``group`` is the smallest fingerprint (as a signed long) of the
    component, ``component_id`` the smallest id in it (null if all its ids are).
    Texts that are null, empty or white space have fingerprint 0 and link like
    any other; equal rows share a component; an empty table gives none.  New
    columns whose names ``docs`` already has get an underscore.

    ``segments``: 3 makes 45 lookups a fingerprint with keys of 21 bits; beyond
    some 10^9 distinct fingerprints 2 (562 lookups, 32 bits) compares less.  The
    result is the same for any number.
    """
    prepared(docs.sparkSession)
    given = docs.columns
    printed, fp = with_fingerprints(docs, text_col, shingle)
    printed = cut(printed, "prints")
    prints = cut(
        printed.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("first_id")), "distinct-prints"
    )
    roots = connected(fingerprint_links(prints.select("fp"), distance, segments))
    known = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    firsts = known.groupBy("root").agg(F.min("first_id").alias("least_id"))
    group, component = fresh(printed, "group", "component_id")
    known = known.join(firsts, "root").select(
        F.col("fp").alias("_fp_of_group"), F.col("root").alias(group), F.col("least_id").alias(component)
    )
    found = printed.join(known, printed[fp] == known["_fp_of_group"])
    return found.select(*given, fp, group, component)


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, **settings
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with its smallest id.

    Rows that repeat that id within the component count as copies too.  A
    component without any id keeps one row.
    """
    found = near_duplicates(docs, id_col, text_col, distance=distance, **settings)
    *given, _, group, component = found.columns
    first = found.filter(F.col(id_col).eqNullSafe(F.col(component)))
    return first.dropDuplicates([group]).select(*given)


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
