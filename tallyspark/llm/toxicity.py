"""Toxicity by a classifier chain.

The categories are predicted in order, each by a logistic regression over the
presence of words and word beginnings and the probabilities of the categories
before it. A later model is trained on probabilities that models of other folds
gave (out-of-fold), so it sees earlier predictions as good as they are on unseen
documents.

The categories before `toxic` are columns of the labels, where the caller names
some. Otherwise they are found in the labelled toxic documents: the words that
mark those are parted into two themes by which of them stand together, and a
theme holds for a toxic document with one of its words. No word list is built in.

Fitting takes a bounded sample of labelled documents; scoring runs over every
whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import prepare, stored, table

#: Labelled documents that a fit takes at most, the smallest hashes of doc_id first.
SAMPLE = 6000
VOCABULARY, FOLDS, THRESHOLD = 512, 5, 0.5
PREFIXES = (4, 5, 6, 7)
#: A word of the vocabulary stands in this share of the toxic documents at least, and so much oftener than in others (standard errors).
MIN_SHARE, MIN_Z = 0.01, 5
#: Categories that are found where labels hold none.
THEMES = ("theme_1", "theme_2")

_words = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def features(text: str | None) -> set[str]:
    """The distinct words of a text, and their beginnings of 4 to 7 letters, each with a hyphen."""
    found = set(words(text))
    return found | {f"{w[:k]}-" for k in PREFIXES for w in found if len(w) > k}


def _sample_rows(batches):
    """The distinct features of each document, and two min-hashes of its five-word shingles."""
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = words(text.as_py())
            grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            least = [min(xxhash.xxh64_intdigest(g, s) for g in grams) - (1 << 63) for s in (1, 2)]
            out.append((doc, *least, sorted(features(text.as_py()))))
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "m1", "m2", "words"])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.2, steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression, the bias last, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, l2 / len(x)), 0]
    rate = 1 / (0.25 * np.linalg.norm(x.T @ x / len(x), 2) + l2 / len(x))
    for t in range(steps):
        grad = x.T @ (1 / (1 + np.exp(-(x @ v))) - y) / len(x) + penalty * v
        w, last = v - rate * grad, w
        v = w + t / (t + 3) * (w - last)
    return w


def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    @classmethod
    def fit(cls, categories, vocabulary, x: np.ndarray, ys: np.ndarray, fold: np.ndarray) -> Chain:
        weights, x = [], x.astype(float)
        for c in range(len(categories)):
            y, unseen = ys[:, c], np.empty(len(x))
            for k in np.unique(fold):
                rest = fold != k
                unseen[~rest] = _p(x[~rest], logistic(x[rest], y[rest])) if rest.any() else y.mean()
            weights.append(logistic(x, y))
            x = np.hstack([x, unseen[:, None]])
        return cls(tuple(categories), vocabulary, weights)

    def predict(self, texts) -> np.ndarray:
        """A row of probabilities for each text, in the order of the categories."""
        x = np.zeros((len(texts), len(self.vocabulary)))
        for i, t in enumerate(texts):
            for w in self.vocabulary.keys() & features(t.as_py() if hasattr(t, "as_py") else t):
                x[i, self.vocabulary[w]] = 1
        for w in self.weights:
            x = np.hstack([x, _p(x, w)[:, None]])
        return x[:, len(self.vocabulary) :]


def themes(x: np.ndarray) -> np.ndarray:
    """Parts marking words (columns of toxic documents' 0/1 rows) in two groups: by the sign of the first principal component, so words that stand together are in one. Group 0 has the first column."""
    if x.shape[1] < 2 or len(x) < 2:
        return np.zeros(x.shape[1], int)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    first = np.linalg.eigh(z.T @ z)[1][:, -1]
    return ((first > 0) != (first[0] > 0)).astype(int)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: tuple[str, ...] = ()) -> Chain | None:
    """A chain for categories (0/1 columns of labels, in their order; THEMES where none are named) and then `toxic`, or None where labels hold no toxic or no other document.

    A doc_id with several labels has the largest of each column. Near copies of
    one labelling in the sample, which agree in two min-hashes, count once, as
    the smallest doc_id of them. Rows with a null id or a null `toxic` are left out; another
    null label is 0.
    """
    spark = prepare(docs.sparkSession)
    largest = [F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"c{i}") for i, c in enumerate(categories)]
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"), *largest)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(_sample_rows, "doc_id long, m1 long, m2 long, words array<string>").join(F.broadcast(chosen), "doc_id")
    given = F.array(*[F.col(f"c{i}") for i in range(len(categories))]).cast("array<int>").alias("given")
    rows = rows.select("doc_id", "m1", "m2", "words", "y", given).groupBy("m1", "m2", "y", "given").agg(F.min(F.struct("doc_id", "words")).alias("r")).select("r.*", "y", "given")
    rows = stored(rows, "toxicity-sample")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = total["n"], total["p"]
    if not 0 < p < n:
        return None
    held = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("b")).where(F.col("a") >= max(3, MIN_SHARE * p))
    rate = F.col("b") / n
    z = (F.col("a") / p - (F.col("b") - F.col("a")) / (n - p)) / F.sqrt(rate * (1 - rate) * (1 / p + 1 / (n - p)))
    top = held.where(F.col("b") < n).withColumn("z", z).where(F.col("z") > MIN_Z).orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(top)}
    kept = F.array_intersect("words", F.lit(sorted(vocabulary)) if vocabulary else F.array().cast("array<string>"))
    found = rows.select("doc_id", "y", kept.alias("words"), "given").orderBy("doc_id").collect()
    x, y = np.zeros((n, len(vocabulary))), np.array([r["y"] for r in found], float)
    for i, r in enumerate(found):
        x[i, [vocabulary[w] for w in r["words"]]] = 1
    if categories:
        earlier = np.array([r["given"] for r in found], float)
    else:
        whole = [i for w, i in vocabulary.items() if not w.endswith("-")]
        part = themes(x[np.ix_(y == 1, whole)])
        earlier = np.stack([y * x[:, [i for i, g in zip(whole, part, strict=True) if g == k]].any(axis=1) for k in range(len(THEMES))], axis=1)
    fold = np.array([xxhash.xxh64_intdigest(str(r["doc_id"])) % FOLDS for r in found])
    return Chain.fit((*(categories or THEMES), "toxic"), vocabulary, x, np.hstack([earlier, y[:, None]]), fold)


def _score(batches, chain: Chain | None, categories: tuple[str, ...], at: int, threshold: float):
    for b in batches:
        probs = chain.predict(list(b.column(at))) if chain else np.zeros((b.num_rows, len(categories)))
        cols = [pa.array(probs[:, i]) for i in range(probs.shape[1])] + [pa.array(probs[:, -1] >= threshold)]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *[f"p_{c}" for c in categories], "is_toxic"])


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_<category> for each category, p_toxic and is_toxic (p_toxic at the threshold or above); columns of these names are replaced.

    Null and empty texts score as texts without words. Without a chain the
    categories are THEMES, all probabilities are 0 and nothing is toxic.
    """
    prepare(docs.sparkSession)
    categories = chain.categories if chain else (*THEMES, "toxic")
    added = [f"p_{c}" for c in categories]
    docs = docs.drop(*added, "is_toxic")
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.DoubleType()) for c in added] + [T.StructField("is_toxic", T.BooleanType())])
    return docs.mapInArrow(partial(_score, chain=chain, categories=categories, at=docs.columns.index("text"), threshold=threshold), schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the chain, fitted on their labels, doesn't find toxic."""
    return score(docs, fit(docs, labels), threshold).where("not is_toxic").select(docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
