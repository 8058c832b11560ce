"""Periodic runs of words: stretches that repeat a few words over and over.

A run is a longest stretch of consecutive words with smallest period q (words q
apart are equal) that is at least MIN_WORDS words and MIN_POWER periods long.

The words of a text become numbers, and bit k of all numbers one big integer: a
plane. For a lag q the planes are XORed with themselves shifted by q, and their
mismatches ORed: zeros are words that equal the one q later. ANDs over doubling
shifts leave the places from which enough zeros follow, which are the runs of
period q; a longer period that a shorter one explains is not the smallest.

Most lags of most texts hold nothing. A lag is looked at where two neighbouring
blocks of 2**k words (2**k <= q < 2**(k+1)) occur again q words later, by hashes
of windows that double with k: a run has MIN_POWER - 1 periods of zeros, so it
covers two whole blocks, and no lag with a run is passed by. Blocks inside a run
of a shorter period don't count: two runs of periods d < q overlap in fewer than
d + q words, and a block of 2**k >= d words with its copy spans that many. A text
of n words takes n log n steps and n / 64 a plane for each lag that is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import carried, prepare, table

MIN_WORDS, MIN_POWER = 6, 4
#: Odd multipliers of the windows' hashes.
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers from 0."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane k as a big integer: its bit i is bit k of ids[i]."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits(((ids >> k) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(width)]


def zero_stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of at least so many places i with ids[i] == ids[i + lag]."""
    apart = 0
    for p in planes:
        apart |= p ^ (p >> lag)
    left = ~apart & ((1 << (n - lag)) - 1)
    span = 1
    while left and 2 * span <= least:
        left &= left >> span
        span *= 2
    left &= left >> (least - span)
    if not left:
        return []
    bits = np.unpackbits(np.frombuffer(left.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").view(np.int8)
    edges = np.diff(bits, prepend=np.int8(0), append=np.int8(0))
    return [(s, e - s + least - 1) for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)]


def _lags(hashes: np.ndarray, width: int, n: int, found: list[tuple[int, int, int]]) -> list[int]:
    """The lags of [width, 2 * width) at which two neighbouring blocks of so many words occur again, as far as no run of a shorter period explains it. hashes: of the windows of so many words from each word on."""
    blocks = n // width
    padded = np.zeros((blocks + 1) * width, np.uint64)
    padded[: len(hashes)] = hashes
    same = padded[width:].reshape(blocks, width) == padded[: blocks * width : width, None]
    at = np.arange(width, 2 * width)
    for j in range(max(0, blocks - 3), blocks):
        same[j] &= j * width + at + width <= n  # else the copy leaves the text
    for start, length, _ in found:
        if length >= 2 * width:
            for j in range(-(-start // width), (start + length - 2 * width) // width + 1):
                same[j, : start + length - j * width - 2 * width + 1] = False
    return (width + np.flatnonzero((same[:-1] & same[1:]).any(axis=0))).tolist()


def periodic_runs(words: list[bytes], min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. Fewer than four periods can't be asked for: blocks are passed by that such runs need."""
    if min_power < 4:
        raise ValueError("min_power is 4 or more")
    n = len(words)
    if n < min_words:
        return []
    ids = numbered(words)
    planes, found, known = bit_planes(ids), [], set()
    hashes, width = (ids.astype(np.uint64) + np.uint64(1)) * _LEFT, 1
    while min_power * width <= n:
        for q in _lags(hashes, width, n, found):
            least = max(min_words - q, (min_power - 1) * q)
            if q + least <= n:
                # Shorter periods come first, so what is known has one.
                fresh = [(s, z + q, q) for s, z in zero_stretches(planes, n, q, least) if (s, z + q) not in known]
                found += fresh
                known.update(r[:2] for r in fresh)
        hashes = (hashes[:-width] * _RIGHT ^ (hashes[:-width] >> np.uint64(29))) + hashes[width:] * _LEFT
        width *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay when each run is cut down to its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]


def split_words(key, text: bytes | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or b"").split()


def _found(batches, words: Callable, keyed: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        counts, runs, kept = [], [], []
        keys = b.column(2).to_pylist() if keyed else [None] * b.num_rows
        for key, text in zip(keys, b.column(1), strict=True):
            w = words(key, text.as_py())
            r = periodic_runs(w)
            counts.append(len(w))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in r])
            kept.append(b" ".join(collapsed(w, r)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["whole", "n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, text: str = "text", words: Callable = split_words, key: str | None = None) -> DataFrame:
    """The columns of docs other than its text, with n_words, runs (an array of start, length and period in words, by start and period) and collapsed (the text's words without what a run repeats, joined by one space); columns of these names are replaced.

    words(key, bytes) cuts a text; key names a column for it. Null, empty and
    blank texts have no words, no runs and an empty collapsed text. Each row
    stands for itself: rows that repeat others, null ids and extra columns
    change nothing. A text is read whole in one task.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    whole, _ = carried(docs, text)
    sent = docs.select(whole, F.col(f"`{text}`").cast("binary").alias("t"), *([F.col(f"`{key}`").alias("k")] if key else []))
    schema = T.StructType([sent.schema[0], *T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed binary").fields])
    done = sent.mapInArrow(partial(_found, words=words, keyed=key is not None), schema)
    return done.select(*[F.col(f"whole.`{c}`") for c in docs.columns if c != text], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of the largest length over period; ties go to the smallest start, then period. Null without runs."""
    power = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    better = lambda a, b: (power(a, b) > 0) | ((power(a, b) == 0) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))


def planted_words(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """The words of op12's contract: where crc32(doc_id) is divisible by ten, those from one place on are replaced by what follows it, over and over."""
    words = split_words(doc_id, text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("long").alias("key"))
    found = with_runs(docs, words=planted_words, key="key").withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    milli = F.expr("best.length * 1000 div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
