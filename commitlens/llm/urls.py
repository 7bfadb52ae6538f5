"""URL filter: wildcard rules as one bit-parallel automaton.

All rules are packed into Shift-And masks of several 64-bit words.  A position of
a rule is a bit; a step over a character shifts the active bits by one, keeps
those whose position takes the character, and lets a wildcard position stay
active.  A batch of URLs is stepped together, so one pass over the characters
of a URL simulates every rule.

A rule is a glob over the canonical URL ``.host/path``: ``*`` takes any
characters but a slash, ``**`` any at all, ``?`` one that is not a slash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import binary, fresh, prepared

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``glob`` over the canonical URL; of the rules that fit, that with the highest rank decides (then the first)."""

    glob: str
    verdict: str
    name: str | None = None
    rank: int = 0


def host_rule(rule: str, verdict: str) -> Rule:
    """``example.org/es/``: the host and its subdomains, paths that start as given; the longer rule ranks higher."""
    host, slash, path = rule.partition("/")
    escaped = "".join("\\" + c if c in "*?\\" else c for c in f"{host}{slash}{path}")
    return Rule(f"*.{escaped}**", verdict, rule, len(rule))


@dataclass
class Automaton:
    """Masks over 64-bit words: ``starts`` are active before the first character."""

    takes: np.ndarray  # [byte, word]: positions that take a byte to get past them
    stays: np.ndarray  # [byte, word]: positions that may stay active on a byte
    starts: np.ndarray  # [word]
    ends: list[tuple[int, int]]  # (word, bit) of each rule's last position


def tokens(glob: str) -> list[str | bytes]:
    """Literal bytes, and "?", "*" or "**"."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out += [bytes([b]) for b in glob[i + 1].encode()]
            i += 2
        elif glob.startswith("**", i):
            out.append("**")
            i += 2
        elif glob[i] in "*?":
            out.append(glob[i])
            i += 1
        else:
            out += [bytes([b]) for b in glob[i].encode()]
            i += 1
    return out


def build(globs: list[str]) -> Automaton:
    """One bit for each state of each rule; a rule of m single characters has m + 1 states, side by side."""
    rules, total = [], 0
    for glob in globs:
        singles, loops = [], {0: set()}
        for t in tokens(glob):
            if t in ("*", "**"):
                loops.setdefault(len(singles), set()).add(t)
            else:
                singles.append(t)
        rules.append((total, singles, loops))
        total += len(singles) + 1
    words = -(-max(total, 1) // 64)
    takes = np.zeros((256, words), np.uint64)
    stays = np.zeros((256, words), np.uint64)
    starts = np.zeros(words, np.uint64)
    at = lambda n: (n >> 6, np.uint64(1 << (n & 63)))
    any_but_slash = np.array([b for b in range(256) if b != ord("/")])
    ends = []
    for first, singles, loops in rules:
        w, bit = at(first)
        starts[w] |= bit
        for k, single in enumerate(singles, 1):
            w, bit = at(first + k)
            bytes_ = any_but_slash if single == "?" else single[0]
            takes[bytes_, w] |= bit
        for k, kinds in loops.items():
            for kind in kinds:
                w, bit = at(first + k)
                stays[slice(None) if kind == "**" else any_but_slash, w] |= bit
        ends.append((first + len(singles)) )
    return Automaton(takes, stays, starts, [(n >> 6, n & 63) for n in ends])


def run(auto: Automaton, texts: list[bytes]) -> np.ndarray:
    """[text, rule]: whether the rule takes the whole text."""
    n = len(texts)
    out = np.zeros((n, len(auto.ends)), bool)
    order = sorted(range(n), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    state = np.broadcast_to(auto.starts, (n, len(auto.starts))).copy()
    live = n
    for step in range(int(lengths[0]) if n else 0):
        live = int(np.searchsorted(-lengths, -step, side="left"))  # longer than step
        chars = np.fromiter((texts[i][step] for i in order[:live]), np.int64, live)
        now = state[:live]
        carry = now >> np.uint64(63)
        moved = now << np.uint64(1)
        moved[:, 1:] |= carry[:, :-1]
        state[:live] = (moved & auto.takes[chars]) | (now & auto.stays[chars])
    for r, (word, bit) in enumerate(auto.ends):
        out[order, r] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
    return out


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule and verdict, appended last.

    ``rule`` is the name of the rule that decides (null if it has none),
    ``verdict`` its verdict, or ``default`` if no rule fits.  A null URL or one
    without ``://`` has an empty host and path.  Equal rows are judged alike; an
    empty table gives none; new columns whose names ``pages`` already has get an
    underscore.  Work is the length of a URL times the words of the masks.
    """
    prepared(pages.sparkSession)
    host, path, rule, verdict = fresh(pages, "host", "path", "rule", "verdict")
    auto = build([r.glob for r in rules])
    order = np.array(sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i)), np.int64)
    names = [rules[i].name for i in order] + [None]
    verdicts = [rules[i].verdict for i in order] + [default]
    given = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            hosts, paths = binary(batch.column(batch.num_columns - 2)), binary(batch.column(batch.num_columns - 1))
            fits = run(auto, [b"." + h + p for h, p in zip(hosts, paths, strict=True)])[:, order]
            won = np.where(fits.any(axis=1), fits.argmax(axis=1), len(order)) if len(order) else np.zeros(len(hosts), int)
            columns = [pa.array([names[w] for w in won], pa.string()), pa.array([verdicts[w] for w in won], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, rule, verdict])

    more = [T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())]
    return given.mapInArrow(batches, T.StructType([*given.schema.fields, *more]))
