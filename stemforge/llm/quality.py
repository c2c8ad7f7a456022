"""Quality by supervised subword embeddings: a text is the mean of learned vectors, and a softmax layer reads it.

The features of a text are its words, the character n-grams of each word between marks of its ends, and its pairs of
neighbouring words, all hashed to rows of one table of vectors. A pair of a word with itself is one feature whatever the word,
so text that repeats words shows. Table and layer are trained by stochastic gradient descent in numpy. The mean and the layer
are linear, so for scoring each feature's vector is reduced to the margin that it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.labelled import SAMPLE, held_out, training_rows
from stemforge.llm.shared import Chunks, groups_of, texts_of, word_hashes

BITS, DIMENSIONS = 18, 8
N_GRAMS = (2, 3, 4)
#: Words of a text that are read at once.
PIECE_WORDS = 20_000
EPOCHS, RATE = 4, 0.4
#: Times the rate, for vectors: a feature's part in the mean is small.
STEP_RATE = 50.0
#: Words of a training text that one step of gradient descent averages; scoring takes whole texts.
STEP_WORDS = 400
MASK = (1 << BITS) - 1
REPEATED = xxhash.xxh64_intdigest("repeated", 9) & MASK
TOKEN = re.compile(r"\S+")


def pair_rows(h: np.ndarray) -> np.ndarray:
    """Rows of the pairs of neighbours among words with these hashes."""
    a, b = h[:-1], h[1:]
    rows = ((((a * np.uint64(0x9E3779B97F4A7C15)) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.where(a == b, REPEATED, rows)


def gram_rows(words: list[str]) -> Iterator[np.ndarray]:
    """Rows of the character n-grams of words; a blank at an end of an n-gram marks an end of its word."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    blank, wide = codes == 32, codes.astype(np.uint64)
    for n in N_GRAMS:
        m = len(codes) - n + 1
        if m < 1:
            continue
        h = wide[:m].copy()
        inside = np.zeros(m, bool)
        for i in range(1, n):
            h = h * np.uint64(0x100000001B3) + wide[i : m + i]
            if i < n - 1:
                inside |= blank[i : m + i]
        h = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        yield (h >> np.uint64(64 - BITS))[~inside].astype(np.int64)


def features(words: list[str]) -> np.ndarray:
    """The rows of all features of a text, repeats included."""
    if not words:
        return np.zeros(0, np.int64)
    h = word_hashes(words)
    return np.concatenate([(h & np.uint64(MASK)).astype(np.int64), pair_rows(h), *gram_rows(words)])


class Model:
    """margin: what each feature adds to the log odds of label 1, times the number of features; bias: the log odds of none."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias


def odds(model: Model, text: str) -> float:
    """The log odds of label 1: the mean margin of the text's features, and the bias."""
    words = TOKEN.findall(text)
    total, n = 0.0, 0
    for start in range(0, len(words), PIECE_WORDS):
        rows = features(words[start : start + PIECE_WORDS])
        total += float(model.margin[rows].sum(dtype=np.float64))
        n += len(rows)
        if start:
            pair = pair_rows(word_hashes(words[start - 1 : start + 1]))
            total += float(model.margin[pair].sum())
            n += 1
    return model.bias + total / n if n else model.bias


def train(texts: list[str], labels: list[int], prior: float, seed: int = 5) -> Model:
    """Softmax over the mean of vectors, SGD with a falling rate; labels are weighed to count alike, then the prior is put back."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    shift = float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, "f4"), shift)
    random = np.random.default_rng(seed)
    vectors = np.zeros((1 << BITS, DIMENSIONS), "f4")
    layer = random.normal(0, 0.5, (DIMENSIONS, 2)).astype("f4")
    y = np.array(labels)
    share = y.mean()
    found, times, owner = Chunks("i4"), Chunks("i4"), []
    for i, t in enumerate(texts):
        words = TOKEN.findall(t)
        for a in range(0, len(words), STEP_WORDS):
            rows, n = np.unique(features(words[a : a + STEP_WORDS]), return_counts=True)
            found.add(rows)
            times.add(n)
            owner.append(i)
    steps, done = EPOCHS * len(owner), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(owner)):
            rows, i = found[k], owner[k]
            part = times[k].astype("f4")
            part /= part.sum()
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = part @ vectors[rows]
            z = hidden @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            d = p.copy()
            d[y[i]] -= 1
            d *= 0.5 / share if y[i] else 0.5 / (1 - share)
            back = layer @ d
            layer -= rate * np.outer(hidden, d)
            vectors[rows] -= np.outer(part * (rate * STEP_RATE), back)
    margin = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(margin.astype("f4"), shift)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from at most 2 * sample labelled rows, in one task; the driver gets the margins of features, of fixed size."""
    rows, prior = training_rows(documents, labels, "quality", sample)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += texts_of(batch)
            y += batch.column("label").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: xxhash.xxh64_intdigest(texts[i]))
        m = train([texts[i] for i in order], [y[i] for i in order], prior)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.margin.astype("<f4").tobytes()], pa.binary())], ["bias", "margin"])

    # the sample is written first, so that one task reads no more than it
    got = rows.coalesce(1).mapInArrow(learn, "bias double, margin binary").collect()
    return Model(np.frombuffer(got[0]["margin"], "<f4"), got[0]["bias"]) if got else Model(np.zeros(1 << BITS, "f4"), 0.0)


def chances(texts: Iterable[str], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.array([odds(model, t) for t in texts], float), -30, 30)))


def score(documents: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document, from its whole text.

    A null text counts as empty; texts without words get the share of label 1; null ids and repeated rows stay, row by row; an
    empty table gives no rows; other columns of the input, whatever their names, are not read.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chances(texts_of(batch), shared.value), pa.float64())], schema.names)

    scored = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored_like(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text"):
    """A column: 1 if the text's score is at least threshold, else 0."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.IntegerType())
    def predicted(texts):
        import pandas as pd

        return pd.Series((chances((t or "" for t in texts), shared.value) >= threshold).astype("int32"))

    return predicted(F.col(text_col).cast("string"))
