"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is
encoded (byte-class bigrams and word repetition through a learned layer); gated
attention, learned from document labels alone, weighs the passages, and the
weighted sum of their encodings is scored. Labels, language, source and id are
never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import prepare, table

PASSAGE = 64
#: Labelled rows that a fit takes at most, the smallest hashes of doc_id first, and the passages of each: spread evenly over a longer text. (Scores see all passages.)
SAMPLE, SAMPLE_PASSAGES = 4000, 256
HIDDEN, ATTENTION, EPOCHS, BAGS = 24, 12, 30, 32

#: Byte classes: white space, newline, lower, upper, digit, high bytes, single signs, other signs.
_SIGNS = "|*&%$#!.,"
CLASSES = 7 + len(_SIGNS)
CLASS_OF = np.full(256, 6, np.int64)
CLASS_OF[[9, 11, 12, 13, 32]] = 0
CLASS_OF[10] = 1
CLASS_OF[97:123] = 2
CLASS_OF[65:91] = 3
CLASS_OF[48:58] = 4
CLASS_OF[128:] = 5
for _i, _c in enumerate(_SIGNS):
    CLASS_OF[ord(_c)] = 7 + _i
FEATURES = CLASSES * CLASSES + 5


def encode(text: str | None) -> np.ndarray:
    """The features of each passage, a row each; a text without words is one passage of zeros."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = CLASS_OF[b]
    edges = np.diff(np.concatenate(([0], (kind > 1).view(np.int8), [0])))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return np.zeros((1, FEATURES), np.float32)
    passage = np.arange(len(start)) // PASSAGE
    n = int(passage[-1]) + 1
    cut = start[::PASSAGE]
    of_byte = np.zeros(len(b), np.int64)
    of_byte[cut[1:]] = 1
    of_byte = np.cumsum(of_byte)
    pairs = np.bincount(of_byte[:-1] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:], minlength=n * CLASSES**2).reshape(n, -1)
    words = np.bincount(passage, minlength=n)
    # A word's hash: the sum of its bytes, each by a weight of its place.
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.concatenate((start, [len(b)]))))[-len(b) :] if start[0] == 0 else np.arange(len(b)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(b)]))))
    value = np.where(kind > 1, (b.astype(np.int64) + 1) * (place * 2654435761 + 40503), 0)
    code = np.add.reduceat(value, start)
    same = np.concatenate(([False], code[1:] == code[:-1]))
    order = np.lexsort((code, passage))
    fresh = np.concatenate(([True], (code[order][1:] != code[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    distinct = np.bincount(passage[order][fresh], minlength=n)
    length = np.bincount(passage, weights=end - start, minlength=n) / words
    rest = np.stack([np.bincount(passage, weights=same, minlength=n) / words, distinct / words, np.minimum(length, 40) / 10, words / PASSAGE, np.bincount(passage, weights=end - start > 20, minlength=n) / words], axis=1)
    return np.hstack([np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True))), rest]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Gated attention over passage encodings (w: parameters by name)."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray):
        """x: passages, standardised; first: the first passage of each bag. Scores, and what the gradient needs."""
        w, size = self.w, np.diff(np.concatenate((first, [len(x)])))
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return _sigmoid(z @ w["c"] + w["c0"]), (h, t, g, a, z, size)

    def gradient(self, x, first, y):
        w = self.w
        p, (h, t, g, a, z, size) = self.forward(x, first)
        d = (p - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"][None, :], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        dt, dg = de[:, None] * w["a"] * g * (1 - t**2), de[:, None] * w["a"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - h**2)
        return {"c": z.T @ d, "c0": d.sum(keepdims=True), "a": (t * g).T @ de, "v": h.T @ dt, "u": h.T @ dg, "enc": x.T @ dh, "enc0": dh.sum(axis=0)}

    @classmethod
    def train(cls, bags: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Model:
        """Adam over batches of bags; both labels weigh alike in sum at most four to one."""
        rng, every = np.random.default_rng(seed), np.concatenate(bags)
        mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
        bags = [(x - mean) / scale for x in bags]
        normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        w = {"enc": normal(FEATURES, HIDDEN), "enc0": np.zeros(HIDDEN), "v": normal(HIDDEN, ATTENTION), "u": normal(HIDDEN, ATTENTION), "a": normal(ATTENTION), "c": normal(HIDDEN), "c0": np.zeros(1)}
        model = cls(mean, scale, w)
        m, v, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BAGS):
                part, step = order[i : i + BAGS], step + 1
                sizes = [len(bags[j]) for j in part]
                grads = model.gradient(np.concatenate([bags[j] for j in part]), np.concatenate(([0], np.cumsum(sizes)[:-1])), y[part])
                rate = 0.003 * (1 - epoch / EPOCHS) + 1e-5
                for k, d in grads.items():
                    d = d + 3e-4 * w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self.forward(x, np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64))[0]


def held_out(doc_id):
    """Rows that no fit sees: crc32 of the id as text leaves 1 by 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _bags(batches):
    for b in batches:
        bags = [encode(t.as_py()) for t in b.column(1)]
        data = [x[np.linspace(0, len(x) - 1, min(len(x), SAMPLE_PASSAGES)).astype(int)].astype(np.float16).tobytes() for x in bags]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most sample labelled rows that aren't held out; None where they don't hold both labels.

    A doc_id with labels of both kinds counts as 0. Rows that repeat a doc_id
    are bags of their own; beyond sample rows those of the largest hashes go.
    """
    prepare(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(_bags, "doc_id long, bag binary").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "bag").limit(sample).collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    return Model.train([np.frombuffer(bytes(r["bag"]), np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows], y)


def _score(batches, model: Model | None, at: int):
    for b in batches:
        p = np.full(b.num_rows, 0.5)
        for i in range(0, b.num_rows, 64) if model else ():
            p[i : i + 64] = model.score([encode(t.as_py()) for t in b.column(at)[i : i + 64]])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(float))], names=[*b.schema.names, "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score, 0 to 1 (a column of that name is replaced). Null and empty texts are one passage without words; without a model all score 0.5."""
    prepare(docs.sparkSession)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(partial(_score, model=model, at=docs.columns.index("text")), schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
