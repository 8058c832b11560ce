"""SimHash near-duplicates through a hierarchical index in Gray order.

1. Every whole text gets a 64-bit fingerprint of its word shingles.
2. Equal fingerprints become one class with the smallest doc_id as its vertex.
3. Upper index nodes are shared masked bit patterns: the free bits are cut in
   three parts, and a fingerprint stands under the three nodes (part, value of
   its bits). Of two fingerprints with two differing bits at most, one part at
   least agrees, so they meet under that node and all other groups are pruned
   unseen. A node with many fingerprints is factored again by thirds of its
   free bits, until at most 14 are free: a node never holds over 2**14
   different fingerprints, whatever the corpus is.
4. Under a node the fingerprints are sorted by Gray rank and runs of them are
   factored into (mask, pattern) nodes; a pair of runs goes on only while the
   differences in the bits that both fix add up to two or less.
5. Links are reduced to a forest in each group, then to connected components
   by rounds of joins, each written to the shared folder.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, shuffle_width, stored, table

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: A node of more fingerprints is factored again.
NODE_ROWS = 4096
#: Entries of a run, and of the runs above.
FANOUT = 8


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    codes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(codes), 128):  # uint8 sums can't overflow in 128 rows
        counts += np.unpackbits(codes[i : i + 128].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(codes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches, shingle: int):
    for b in batches:
        prints = np.fromiter((_fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Fewer words than a shingle are one shingle; no words, or null, give 0."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The position of a word in the reflected Gray code: each bit is the parity of the bits above it. Unsigned, in a long."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[: n // 3], bits[n // 3 : 2 * n // 3], bits[2 * n // 3 :]]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _levels() -> list[list[tuple[int, list[int]]]]:
    """Per level, a node kind's (parent kind, free bits); the kind is its place in the list. Level 0 is the root."""
    out: list[list[tuple[int, list[int]]]] = [[(0, list(range(63, -1, -1)))]]
    while len(out[-1][0][1]) > 14:
        out.append([(k, [b for b in free if b not in set(part)]) for k, (_, free) in enumerate(out[-1]) for part in _thirds(free)])
    return out


def nodes(classes: DataFrame) -> DataFrame:
    """(kind, node, fp, vertex): every class under the index nodes that hold it and another one."""
    levels, done, depth = _levels(), [], 1
    rest = classes.select("fp", "vertex", F.lit(0).alias("kind"))
    while True:
        kinds = levels[depth]
        children = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(_mask([b for b in range(64) if b not in set(free)])).cast("long").alias("mask"), F.lit(parent).alias("parent")) for k, (parent, free) in enumerate(kinds)])
        below = rest.select("fp", "vertex", F.explode(F.filter(children, lambda c: c["parent"] == F.col("kind"))).alias("c"))
        below = below.select("fp", "vertex", F.col("c.kind").alias("kind"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("node"))
        sizes = below.groupBy("kind", "node").agg(F.count("*").alias("n")).where("n > 1")
        if depth == len(levels) - 1:
            done.append(below.join(sizes, ["kind", "node"]).select(F.lit(depth).alias("level"), "kind", "node", "fp", "vertex"))
            break
        sizes = stored(sizes, "simhash-nodes")
        done.append(below.join(sizes.where(F.col("n") <= NODE_ROWS), ["kind", "node"]).select(F.lit(depth).alias("level"), "kind", "node", "fp", "vertex"))
        hot = sizes.where(F.col("n") > NODE_ROWS)
        if hot.isEmpty():
            break
        rest = stored(below.join(hot, ["kind", "node"]).select("fp", "vertex", "kind"), "simhash-hot")
        depth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _runs(fp: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The tree over sorted fingerprints: a list of levels (pattern, mask, first child, children), leaves first; each group has a root of its own in the last."""
    levels, all_ones = [], np.uint64(0xFFFFFFFFFFFFFFFF)
    low, high = fp, fp  # AND and OR of what stands below
    while True:
        n = -(-size // FANOUT)
        offsets = np.concatenate(([0], np.cumsum(n)))
        inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
        at = np.repeat(first, n) + inner * FANOUT
        many = np.minimum(FANOUT, np.repeat(size, n) - inner * FANOUT)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        levels.append((low, all_ones ^ (low ^ high), at, many))
        first, size = offsets[:-1], n
        if (size == 1).all():
            return levels


def _children(a, b, at, many):
    """All pairs of a child of a and a child of b; where a is b, pairs with i <= j."""
    i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
    keep = (i < many[a][:, None]) & (j < many[b][:, None]) & ((a != b)[:, None] | (i <= j))
    return (at[a][:, None] + i)[keep], (at[b][:, None] + j)[keep]


def _links(fp: np.ndarray, first: np.ndarray, size: np.ndarray, max_bits: int):
    """Pairs of rows in one group that differ in max_bits or fewer bits. Pairs of runs are worked off in slices, deepest first, so memory stays bounded."""
    levels, roots = _runs(fp, first, size), np.arange(len(first))
    stack = [(len(levels) - 1, roots[i : i + 50_000], roots[i : i + 50_000]) for i in range(0, len(roots), 50_000)]
    while stack:
        k, a, b = stack.pop()
        pattern, mask, at, many = levels[k]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits
        a, b = _children(a[near], b[near], at, many)
        if k:
            stack += [(k - 1, a[i : i + 50_000], b[i : i + 50_000]) for i in range(0, len(a), 50_000)]
        else:
            near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits)
            yield a[near], b[near]


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hooks the larger root of each pair under the smaller, until all pairs agree."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up
    return root


def _forest(batches, max_bits: int):
    """Rows sorted by node and Gray rank in, (child, parent) links of each node's forest out. Whole nodes are worked on together, 32,768 rows or one node at a time."""
    held = None

    def work(rows):
        node, fp, vertex = rows
        cut = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]).any(axis=1))))
        size = np.diff(np.concatenate((cut, [len(fp)])))
        root = np.arange(len(fp))
        for a, b in _links(fp, cut, size, max_bits):
            root = _join_roots(root, a, b)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        least = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(least, root, vertex)
        linked = np.unique(np.concatenate((linked, root[linked])))
        child, parent = vertex[linked], least[root[linked]]
        return pa.RecordBatch.from_arrays([pa.array(child[child != parent]), pa.array(parent[child != parent])], names=["child", "parent"])

    for b in batches:
        rows = (np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1), b.column(3).to_numpy(zero_copy_only=False).view(np.uint64), b.column(4).to_numpy(zero_copy_only=False))
        held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        if len(held[1]) >= 32_768:
            last = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0  # the last node may go on in the next batch
            if end:
                yield work(tuple(x[:end] for x in held))
                held = tuple(x[end:] for x in held)
    if held is not None and len(held[1]):
        yield work(held)


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(child, parent): links between vertices whose fingerprints differ in max_bits (2 at most, as three parts are cut) or fewer bits, as forests with the smallest vertex on top."""
    if max_bits > 2:
        raise ValueError("three parts find two differing bits at most")
    spark = prepare(classes.sparkSession)
    dealt = nodes(classes).withColumn("rank", gray_rank(F.col("fp"))).withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
    dealt = dealt.repartition(shuffle_width(spark), "level", "kind", "node").sortWithinPartitions("level", "kind", "node", "rank")
    return dealt.select("level", "kind", "node", "fp", "vertex").mapInArrow(partial(_forest, max_bits=max_bits), "child long, parent long")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for each vertex with an edge.

    Each round points every vertex at its smallest neighbour so far (a minimum,
    aggregated before the shuffle), carries its other edges over to it, and
    halves the paths; it ends when nothing but stars is left.
    """
    edges = stored(edges.where("child != parent").distinct(), "simhash-edges")
    while True:
        up = stored(edges.groupBy("child").agg(F.min("parent").alias("top"), F.max("parent").alias("other")), "simhash-tops")
        above = up.select(F.col("child").alias("top"), F.col("top").alias("topmost"))
        jumped = up.join(above, "top", "left").select("child", F.coalesce("topmost", "top").alias("parent"))
        moved = up.where("top < other").select("child", "top").join(edges, "child").where("parent != top").select(F.col("parent").alias("child"), F.col("top").alias("parent"))
        state = up.join(above, "top", "left").agg(F.coalesce(F.sum(((F.col("top") != F.col("other")) | F.col("topmost").isNotNull()).cast("int")), F.lit(0))).first()[0]
        if not state:
            return up.select(F.col("child").alias("vertex"), F.col("top").alias("component")).unionByName(up.select(F.col("top").alias("vertex"), F.col("top").alias("component")).distinct())
        edges = stored(jumped.unionByName(moved).distinct(), "simhash-edges")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: the smallest doc_id that links of max_bits differing bits reach.

    Rows without words (null, empty) have fingerprint 0 and link like others.
    Rows that repeat a doc_id keep a row each, and link what they are near to:
    all rows of one doc_id are in one component. Rows without a doc_id get their
    fingerprint and a null component. Extra columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    classes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("vertex")), "simhash-classes")
    # A doc_id that repeats with other texts stands in several classes: edges from the id to their vertices.
    again = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id")
    through = prints.join(again, "doc_id").join(classes, "fp").where("doc_id > vertex").select(F.col("doc_id").alias("child"), F.col("vertex").alias("parent")).distinct()
    found = components(links(classes, max_bits).unionByName(through))
    labels = classes.join(found, "vertex", "left").select("fp", F.coalesce("component", "vertex").alias("component_id"))
    out = prints.join(labels, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
