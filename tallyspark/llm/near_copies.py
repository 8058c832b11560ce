"""Near copies by exact Jaccard similarity of word shingles, for the pipeline.

1. Every whole text gets the set of its five-word shingles (words as SimHash
   takes them), a SimHash fingerprint of it and BANDS hashes of ROWS min-hashes,
   which are its sketch.
2. Texts of equal sets become one class; its vertex is the least of its rows.
3. Candidates are classes that share a bucket: a band, or a component of SimHash
   links, and whose sketches agree in AGREE bands or whose fingerprints are
   links. Two sets of similarity s share a band with probability s**5; at 0.8,
   three or more of 32 with 0.9996, and above with more. That is the only place
   where a pair can be missed.
4. First each class meets the lead of its buckets and a few others: as many
   pairs as there are classes. That ends the buckets in which all are alike, and
   those of PIVOTS classes or fewer, all of whose pairs have met. The classes of
   the others are dealt in blocks, and each two blocks of a bucket meet as two
   packed rows, whose links are all that comes out of it. Who meets and agrees
   is compared shingle by shingle (as 64-bit hashes).
5. Pairs of SIMILARITY and more are links; a group is what links connect.

Of a bucket of many classes that are alike enough to meet and not to be linked
all pairs of sketches are compared, block by block, a block of so many at a time.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.common import HOT, carried, freed, hot_join, prepare, stored

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, AGREE = 32, 5, 3
#: Classes of a bucket, besides its lead, that all others are compared with first, and about how many are in a block afterwards.
PIVOTS, BLOCK = 3, 256
#: Odd multipliers of the min-hashes.
_TURNS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def codes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes. Fewer words than a shingle are one shingle; no words have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def _bands(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (_TURNS[:, None] * found[i : i + 1024]).min(axis=1))
    digests = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _sets(batches, at: int, shingle: int):
    for b in batches:
        texts = b.column(at).to_pylist()
        sets = [codes(t, shingle) for t in texts]
        bands = [_bands(s) for s in sets]
        columns = [
            pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array(np.array([simhash._fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())),
            pa.array([(np.array(x, np.int64) & 0xFFFFFFFF).astype(np.uint32).tobytes() for x in bands], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([*b.columns[:at], *columns], names=[*b.schema.names[:at], "key", "n", "fp", "bands", "sketch"])


def _agree(batches, agree: int, max_bits: int):
    """Of pairs that meet in a bucket (its band, both fingerprints and both sketches), those that may be similar: once each, in the first band they agree in, or by their fingerprints alone."""
    for b in batches:
        if not b.num_rows:
            continue
        band = b.column(2).to_numpy(zero_copy_only=False)
        fp = [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (3, 4)]
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (5, 6))
        same = x == y
        enough = same.sum(axis=1) >= agree
        keep = np.where(band == BANDS, ~enough & (np.bitwise_count(fp[0] ^ fp[1]) <= max_bits), enough & (same.argmax(axis=1) == band))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["child", "parent"]).filter(pa.array(keep))


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _meet(batches, agree: int, max_bits: int, similarity: float):
    """Links between two blocks (or within one) of a bucket: of pairs that _agree() would let pass, of different components and fitting sizes, those that are similar. Who is linked already isn't compared again."""
    for b in batches:
        child, parent = [], []
        for band, alone, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            p, q = ({k: x.values.field(k) for k in ("vertex", "n", "component", "fp", "sketch", "codes")} for x in (x, y))
            num = lambda c, kind=np.int64: c.to_numpy(zero_copy_only=False).astype(np.int64).view(kind)
            sx, sy = (np.frombuffer(b"".join(c["sketch"].to_pylist()), np.uint32).reshape(len(c["vertex"]), -1) for c in (p, q))
            count, first = np.zeros((len(sx), len(sy)), np.uint8), np.full((len(sx), len(sy)), BANDS, np.uint8)
            for k in reversed(range(BANDS)):
                same = sx[:, k, None] == sy[None, :, k]
                count += same
                first[same] = k
            n, m = num(p["n"])[:, None], num(q["n"])[None, :]
            near = count >= agree
            keep = near & (first == band) if band < BANDS else ~near & (np.bitwise_count(num(p["fp"], np.uint64)[:, None] ^ num(q["fp"], np.uint64)[None, :]) <= max_bits)
            one, other = num(p["component"]), num(q["component"])
            keep &= (one[:, None] != other[None, :]) & (np.minimum(n, m) >= similarity * np.maximum(n, m))
            if alone:
                keep = np.triu(keep, 1)
            u, v, root = num(p["vertex"]), num(q["vertex"]), {}

            def top(c, root=root):
                while c in root:
                    c = root[c]
                return c

            for i, j in zip(*(k.tolist() for k in np.nonzero(keep)), strict=True):
                s, t = top(int(one[i])), top(int(other[j]))
                if s != t and _alike(*(np.frombuffer(c["codes"][k].as_buffer(), np.uint64) for c, k in ((p, i), (q, j))), similarity):
                    root[max(s, t)] = min(s, t)
                    child.append(max(int(u[i]), int(v[j])))
                    parent.append(min(int(u[i]), int(v[j])))
        if child:
            yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], names=["child", "parent"])


def _coded(batches, shingle: int):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codes(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["vertex", "codes"])


def _verify(batches, similarity: float):
    for b in batches:
        keep = [_alike(*(np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3)), similarity) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["child", "parent"]).filter(pa.array(keep, pa.bool_()))


def _links(members: DataFrame, coded: DataFrame, similarity: float) -> DataFrame:
    """(vertex, component) of the vertices that links reach: members are (bucket, band, vertex, n, fp, sketch, weight), coded (vertex, codes: its shingles)."""
    kind = "child long, parent long"

    # The weightiest of a bucket meets all others first: what many copies were made of is nearer to each of them than they are to each other.
    lead = F.max_by("vertex", F.struct("weight", -F.col("vertex")))
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("many"), lead.alias("lead")), "copies-sizes")
    hot = F.col("many") > sizes.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0] / HOT
    named = stored(hot_join(members, sizes, ["bucket"], hot), "copies-named")
    drawn = F.pmod(F.xxhash64("vertex", "bucket"), F.col("many")) < PIVOTS
    pivots = named.where(drawn | (F.col("vertex") == F.col("lead"))).select("bucket", "many", *[F.col(c).alias(f"p_{c}") for c in ("vertex", "n", "fp", "sketch")])
    met = hot_join(members, pivots, ["bucket"], hot)
    fits = (F.col("vertex") != F.col("p_vertex")) & (F.least("n", "p_n") >= similarity * F.greatest("n", "p_n"))
    met = met.where(fits).select(F.greatest("vertex", "p_vertex").alias("child"), F.least("vertex", "p_vertex").alias("parent"), "band", "fp", "p_fp", "sketch", "p_sketch")
    pairs = met.mapInArrow(partial(_agree, agree=AGREE, max_bits=simhash.MAX_BITS), kind).distinct()
    both = pairs.join(coded.select(F.col("vertex").alias("child"), F.col("codes").alias("a")), "child").join(coded.select(F.col("vertex").alias("parent"), F.col("codes").alias("b")), "parent")
    links = stored(both.select("child", "parent", "a", "b").mapInArrow(partial(_verify, similarity=similarity), kind), "copies-links")
    found = stored(simhash.components(links), "copies-found")

    # All of a bucket no larger than the pivots have met.
    held = stored(named.where(F.col("many") > PIVOTS).join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")), "copies-held")
    freed(sizes, named, found)
    apart = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    left = held.join(apart, "bucket", "left_semi").join(coded, "vertex").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    packed = left.groupBy("bucket", "band", "blocks", block.alias("block")).agg(F.collect_list(F.struct("vertex", "n", "component", "fp", "sketch", "codes")).alias("rows"))
    packed = stored(packed, "copies-blocks")
    one = packed.select("bucket", "band", F.col("block").alias("i"), F.col("rows").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    two = packed.select(F.col("bucket").alias("_b"), F.col("block").alias("_j"), F.col("rows").alias("y"))
    blocks = one.join(two, (F.col("bucket") == F.col("_b")) & (F.col("j") == F.col("_j"))).select("band", (F.col("i") == F.col("j")).alias("alone"), "x", "y")
    more = blocks.mapInArrow(partial(_meet, agree=AGREE, max_bits=simhash.MAX_BITS, similarity=similarity), kind)
    out = stored(simhash.components(links.unionByName(more)), "copies-found")
    freed(links, held, packed)
    return out


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """Stored rows of docs (row: a number of their own; id, whole, text) and their keys (id, key); for each key its rows, and the first row (id, row) of its group; and what selects docs' columns back.

    The texts are stored once, and what a step has used up is deleted: disk holds the texts and one step's tables.
    """
    prepare(docs.sparkSession)
    whole, back = carried(docs)
    # Written once, so that a row's number stays what it is.
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), whole, "text"), "copies-rows", "zstd")
    kind = "row long, id long, key string, n long, fp long, bands array<long>, sketch binary"
    sets = stored(rows.select("row", "id", "text").mapInArrow(partial(_sets, at=2, shingle=shingle), kind), "copies-sets")
    classes = sets.where("id is not null").groupBy("key").agg(
        F.min("row").alias("vertex"), F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("rows"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
    )
    classes, keys = stored(classes, "copies-classes"), stored(sets.select("id", "key"), "copies-keys")
    freed(sets)
    firsts = stored(classes.select("key", "vertex", "first", "rows"), "copies-firsts")
    worded = classes.where("n > 0")  # the class of no words has no links

    prints = simhash.components(simhash.links(worded.select("fp", F.col("fp").alias("vertex")).distinct()))
    close = worded.join(prints.withColumnRenamed("vertex", "fp"), "fp", "left").select("vertex", F.lit(BANDS).alias("band"), F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("bucket"))
    every = stored(close.unionByName(worded.select("vertex", F.posexplode("bands").alias("band", "bucket"))), "copies-members")
    shared = stored(every.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1"), "copies-shared")
    hot = F.col("many") > shared.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0] / HOT
    met = stored(hot_join(every, shared, ["bucket"], hot), "copies-met")
    freed(every, shared)
    # How many a class shares its buckets with.
    weights = met.groupBy("vertex").agg(F.sum("many").alias("weight"))
    members = stored(met.drop("many").join(weights.join(worded.select("vertex", "n", "fp", "sketch"), "vertex"), "vertex"), "copies-weighed")
    freed(met, classes)
    texts = rows.select(F.col("row").alias("vertex"), "text").join(members.select("vertex").distinct(), "vertex").select("vertex", "text")
    coded = stored(texts.mapInArrow(partial(_coded, shingle=shingle), "vertex long, codes binary"), "copies-codes")

    found = _links(members, coded, similarity)
    freed(members, coded)
    labels = firsts.join(found, "vertex", "left").select("key", "rows", "first", F.coalesce("component", "vertex").alias("component"))
    least = labels.groupBy("component").agg(F.min("first").alias("first"))
    labels = stored(labels.drop("first").join(least, "component").drop("component"), "copies-labels")
    freed(firsts, found)
    return rows, keys, labels, back


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) per row of docs: the smallest doc_id of the group. BANDS and ROWS are made for similarities of 0.8 and more.

    Texts without words (null, empty) are copies of each other. Rows that repeat
    a doc_id keep a row each, and each is in the group of its own text. Rows
    without a doc_id get a null component. Extra columns are ignored.
    """
    rows, keys, labels, _ = _grouped(docs.select("doc_id", "text"), shingle, similarity)
    freed(rows)
    named, hot = keys.where("id is not null"), F.col("rows") > keys.count() / HOT
    with_id = hot_join(named, labels, ["key"], hot).select(F.col("id").alias("doc_id"), F.col("first.id").alias("component_id"))
    return with_id.unionByName(keys.where("id is null").select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("component_id")))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: the one of the smallest doc_id, and one of several rows that have it. Rows without a doc_id all stay."""
    rows, keys, labels, back = _grouped(docs, shingle, similarity)
    freed(keys)
    gone = rows.where("id is not null").select("row").join(labels.select(F.col("first.row").alias("row")).distinct(), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*back)
