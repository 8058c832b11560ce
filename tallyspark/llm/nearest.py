"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's code is the sign of each coordinate of its offset from the centre,
padded with zeros and rotated at random: one bit a dimension, in 64-bit words.
With o the unit offset and s the code as a vector of +-1/sqrt(B), <o, q> is
estimated by <s, q> / <s, o>, and the error has a known scale,
|q| sqrt((1 - <s, o>^2) / <s, o>^2 / (B - 1)). <s, q> comes from packed words
alone: the rotated query is rounded to four bits a coordinate, cut in four bit
planes, and the bits that a code shares with each plane are counted. Vectors
whose estimate plus the bound reaches the score to beat are reranked on the
original vectors, in double precision; all others are ruled out by their code.

Every row is indexed, in blocks of packed codes, norms and correction scalars;
a block's vectors lie beside them as bytes, which are looked at only where a
code can't rule a row out. Queries are taken in blocks of fixed size, which are
broadcast; each block passes over all codes, task by task, and a task returns
a query's best few rows, so no task holds more than a block of either side.
Each block's rows are written before the next is taken up, so the plan and what
is broadcast stay as small with a thousand blocks as with one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, shared_path, stored, table

#: The bound, in error scales. A neighbour is ruled out wrongly in about 3 of 100 cases at most.
BOUND = 1.9
#: Bits a coordinate of a rotated query is rounded to.
PLANES = 4
#: Rows the centre and the first scores to beat are taken from, queries in a block (16,384 x 64 doubles are 8 MB), and vectors in a block of codes.
SAMPLE, QUERY_BLOCK, ROWS = 4096, 16_384, 8192


def code_bits(dim: int) -> int:
    """One bit a dimension, in whole words."""
    return -(-dim // 64) * 64


def _matrix(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, and which rows take part: of length n, finite, not zero."""
    values = column.to_pylist()
    ok = np.array([bool(v) and len(v) == n and None not in v for v in values], bool)
    x = np.zeros((len(values), n))
    if ok.any():
        x[ok] = np.array([v for v, k in zip(values, ok, strict=True) if k], float)
    ok &= np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x[~ok] = 0
    return x, ok


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """dim orthonormal rows of length bits: the part of a random rotation that meets a padded vector."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))
    return (q * np.sign(np.diag(r))).T


def _encode(batches, centre: np.ndarray, turn: np.ndarray):
    held, n = [], 0

    def block():
        ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
        offset = x - centre
        norm = np.linalg.norm(offset, axis=1)
        y = (offset / np.maximum(norm, 1e-300)[:, None]) @ turn
        fit = np.where(norm > 0, np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1]), 1.0)  # <s, o>
        packed = np.packbits(y > 0, axis=1, bitorder="little")
        columns = [ids.astype(np.int64), packed, norm, fit, x]
        return pa.RecordBatch.from_arrays([pa.array([len(ids)]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=["n", "ids", "codes", "norms", "fits", "vectors"])

    for b in batches:
        x, ok = _matrix(b.column(1), len(centre))
        ids = b.column(0).to_numpy(zero_copy_only=False)[ok]
        for i in range(0, len(ids), ROWS):
            part = ids[i : i + ROWS], x[ok][i : i + ROWS]
            if n + len(part[0]) > ROWS:
                yield block()
                held, n = [], 0
            held.append(part)
            n += len(part[0])
    if n:
        yield block()


BLOCK = "n long, ids binary, codes binary, norms binary, fits binary, vectors binary"


def index(vectors: DataFrame, centre: np.ndarray) -> DataFrame:
    """Blocks of every row that takes part (its vector has the centre's length, is finite and not zero): packed codes with their norms and correction scalars, ids, and vectors as bytes."""
    turn = rotation(len(centre), code_bits(len(centre)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(partial(_encode, centre=centre, turn=turn), BLOCK)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def planes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries rounded to PLANES bits a coordinate: the packed bit planes (query, plane, word), and the offset and step of each query's numbers."""
    low = rotated.min(axis=1, keepdims=True)
    step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((rotated - low) / step).astype(np.uint8)
    bits = np.stack([level >> k & 1 for k in range(PLANES)], axis=1)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), low[:, 0], step[:, 0]


def estimates(codes: np.ndarray, held: np.ndarray, plane: np.ndarray, low: float, step: float, total: float) -> np.ndarray:
    """<s, q> for every code (row, word): held counts a code's bits, total is the sum of the rotated query."""
    # Wide enough for a code that shares all bits of every plane, however long vectors are.
    kind = np.min_scalar_type((2**PLANES - 1) * 64 * codes.shape[1])
    shared = np.zeros(len(codes), kind)
    for k in range(PLANES):
        shared += np.bitwise_count(codes & plane[k]).sum(axis=1, dtype=kind) << k
    return (2 * (low * held + step * shared) - total) / np.sqrt(64 * codes.shape[1])


def _scan(batches, queries, centre: np.ndarray, turn: np.ndarray, k: int, bound: float):
    ids, q, beat = queries.value
    beat = beat.copy()
    bits, dim, qn, at_centre = turn.shape[1], len(centre), np.linalg.norm(q, axis=1), q @ centre
    rotated = q @ turn
    plane, low, step = planes(rotated)
    # The sum of what the rounded query stands for.
    total = low * bits + step * sum(np.bitwise_count(plane[:, j]).sum(axis=1, dtype=np.int64) << j for j in range(PLANES))
    best_score, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    for b in batches:
        for at in range(b.num_rows):
            read = lambda name, kind: np.frombuffer(b.column(name)[at].as_buffer(), kind)  # noqa: B023, E731
            vec, codes = read("ids", np.int64), read("codes", np.uint64).reshape(-1, bits // 64)
            norm, fit, x = read("norms", float), read("fits", float), read("vectors", float).reshape(-1, dim)
            held = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            scale = norm / fit
            error = bound * norm * np.sqrt(np.maximum(0, 1 - fit**2) / np.maximum(fit, 1e-9) ** 2 / (bits - 1))
            for r in range(len(ids)):
                # <x, q> = <centre, q> + norm <o, q>
                upper = estimates(codes, held, plane[r], low[r], step[r], total[r]) * scale + qn[r] * error
                near = np.flatnonzero((upper >= beat[r] - at_centre[r] - 1e-9) & (vec != ids[r]))
                if not len(near):
                    continue
                exact = np.einsum("j,ij->i", q[r], x[near])
                reach = exact >= beat[r] - 1e-12
                s, v = np.concatenate((best_score[r], exact[reach])), np.concatenate((best_id[r], vec[near[reach]]))
                top = _best(s, v, k)
                best_score[r], best_id[r] = s[top], v[top]
                beat[r] = max(beat[r], s[top[-1]])
    found = best_score > -np.inf
    if found.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(axis=1))), pa.array(best_id[found]), pa.array(best_score[found])], names=["query_id", "vec_id", "score"])


def _rows(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow().combine_chunks()
    x, ok = _matrix(t.column("embedding").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())), n)
    return t.column("vec_id").to_numpy()[ok], x[ok]


def search(vectors: DataFrame, is_query, k: int = 20, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row, its own vec_id left out.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; neither do vectors of another length than most of the sample have.
    Ties go to the smaller vec_id. Queries that repeat a vec_id count once, by
    the vector that sorts first. With fewer candidates than k all are returned.
    """
    spark = prepare(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.where("vec_id is not null and size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = sample.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not dims:
        return empty
    seen_ids, seen = _rows(sample.where(F.size("embedding") == dims[0]["n"]), dims[0]["n"])
    if not len(seen):
        return empty
    centre = seen.mean(axis=0)
    turn = rotation(len(centre), code_bits(len(centre)))
    codes = stored(index(vectors.where("vec_id is not null"), centre), "codes")
    whole = (F.size("embedding") == len(centre)) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    asked = vectors.where("vec_id is not null").where(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.where(whole).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Blocks of ids of even size: a few numbers go to the driver, not the queries.
    n = asked.count()
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))).cast("int")), "queries")
    folder, kind = shared_path(spark, "nearest"), "query_id long, vec_id long, score double"
    done = []
    for block in range(max(1, -(-n // QUERY_BLOCK))):
        ids, q = _rows(asked.where(F.col("block") == block), len(centre))
        if not len(ids):
            continue
        first = q @ seen.T  # the k-th best of the sample is beaten or met by any of the k best of all
        first[ids[:, None] == seen_ids[None, :]] = -np.inf
        beat = np.partition(first, -k, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(ids), -np.inf)
        sent = spark.sparkContext.broadcast((ids, q, beat))
        scan = partial(_scan, queries=sent, centre=centre, turn=turn, k=k, bound=bound)
        done.append(f"{folder}/{block}")
        codes.mapInArrow(scan, kind).write.parquet(done[-1])
        sent.unpersist()
    if not done:
        return empty
    out = spark.read.schema(kind).parquet(*done)
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("place", "b"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.minus")).alias("score"))


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
