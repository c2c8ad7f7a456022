"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs i < j of <v_i, v_j>), over the distinct terms of a text. Terms are lower-case words
and the beginnings of words, so inflected insults share one; the pairwise part learns what only two terms together mean. The
sum over pairs costs one pass: half of |sum of v|**2 - sum of |v|**2.
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
from stemforge.llm.shared import Chunks, groups_of, texts_of

WORD = re.compile(r"\w+")
BITS, FACTORS = 20, 4
#: Lengths of the beginnings that are terms of their own.
BEGINNINGS = (4, 5)
#: Words whose terms a task keeps.
KEPT_WORDS = 60_000
EPOCHS = 6
#: Terms of fewer training texts are not learned.
LEAST_TEXTS = 4
#: Nor terms whose shares among the texts of either label differ by fewer standard deviations, unless they are part of a pair of
#: words, at most NEAR words apart, whose shares differ by PAIR_GAP: words that mean nothing alone may do so together.
LEAST_GAP, PAIR_GAP = 2.5, 8.0
NEAR, PAIR_BITS = 4, 20
#: Rates and penalties of the single weights (FTRL, which leaves what doesn't matter at 0) and of the factors (SGD).
W_RATE, W_ONE, W_TWO = 0.1, 2.0, 1.0
V_RATE, V_DECAY = 0.02, 1e-3


class Terms(dict):
    """word -> the hashed terms it gives."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > KEPT_WORDS:
            self.clear()
        mask = (1 << BITS) - 1
        found = self[word] = [xxhash.xxh64_intdigest(word, 1) & mask, *(xxhash.xxh64_intdigest(word[:n], 1 + n) & mask for n in BEGINNINGS if len(word) > n)]
        return found


def term_ids(text: str, terms: Terms) -> np.ndarray:
    """The distinct hashed terms of a whole text."""
    ids: set[int] = set()
    for word in set(WORD.findall(text.lower())):
        ids.update(terms[word])
    return np.fromiter(ids, np.int64, len(ids))


def near_pairs(text: str, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and second term of each pair of different words that are at most NEAR words apart."""
    ids = np.array([terms[w][0] for w in WORD.findall(text.lower())], np.int64)
    a = np.concatenate([ids[:-k] for k in range(1, NEAR + 1)])
    b = np.concatenate([ids[k:] for k in range(1, NEAR + 1)])
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64), a, b


def gaps(by: list[np.ndarray], n: tuple[int, int]) -> np.ndarray:
    """By how many standard deviations the shares of texts of either label that have something differ: 0 for what LEAST_TEXTS lack."""
    met = by[0] + by[1]
    both = met / (n[0] + n[1])
    gap = np.abs(by[1] / n[1] - by[0] / n[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n[0] + 1 / n[1]))
    return np.where(met >= LEAST_TEXTS, gap, 0.0)


class Machine:
    """Weights and factors of the terms that have any (ids, rising), and the margin of a set of terms."""

    def __init__(self, bias: float, ids: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.ids, self.w, self.v = bias, ids.astype(np.int64), w, v

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of those of the terms that have any."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        return at[self.ids[at] == ids] if len(self.ids) else at[:0]

    def margin(self, ids: np.ndarray) -> float:
        at = self.rows(ids)
        v = self.v[at]
        s = v.sum(0)
        return float(self.bias + self.w[at].sum() + 0.5 * (s @ s - np.einsum("ij,ij->", v, v)))


def train(texts: list[str], labels: list[int], prior: float, seed: int = 7) -> Machine:
    """Logistic loss, labels weighed so that each counts alike (of one label only, the prior is all that is learned); terms of few texts, or alike under both labels alone and in pairs, stay 0."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    shift = float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Machine(shift, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    terms, y = Terms(), np.array(labels)
    rows = Chunks("i4")
    for t in texts:
        rows.add(term_ids(t, terms))
    n = tuple(labels.count(a) for a in (0, 1))
    met = [np.zeros(1 << BITS, np.int32) for _ in (0, 1)]
    for r, label in zip(rows, labels):
        met[label][r] += 1
    learned = gaps(met, n) >= LEAST_GAP
    pairs = [np.zeros(1 << PAIR_BITS, np.int32) for _ in (0, 1)]
    for text, label in zip(texts, labels):
        pairs[label][np.unique(near_pairs(text, terms)[0])] += 1
    telling = gaps(pairs, n) >= PAIR_GAP
    for text in texts:
        h, first, second = near_pairs(text, terms)
        learned[first[telling[h]]] = learned[second[telling[h]]] = True
    used = np.flatnonzero(learned)
    place = np.zeros(1 << BITS, np.int64)
    place[used] = np.arange(len(used))
    kept = Chunks("i4")
    for r in rows:
        kept.add(place[r[learned[r]]])
    rows = kept
    random = np.random.default_rng(seed)
    lw, lv = np.zeros(len(used)), random.normal(0, 0.02, (len(used), FACTORS))
    z, squares = np.zeros(len(used)), np.zeros(len(used))
    bias, share = 0.0, y.mean()
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            ids = rows[i]
            zi, ni, vi = z[ids], squares[ids], lv[ids]
            wi = np.where(np.abs(zi) <= W_ONE, 0, (np.sign(zi) * W_ONE - zi) / ((1 + np.sqrt(ni)) / W_RATE + W_TWO))
            s = vi.sum(0)
            margin = bias + wi.sum() + 0.5 * (s @ s - np.einsum("ij,ij->", vi, vi))
            g = float(1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[i]) * (0.5 / share if y[i] else 0.5 / (1 - share))
            bias -= 0.02 * g
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / W_RATE * wi
            squares[ids] = ni + g * g
            lv[ids] = vi - V_RATE * np.clip(g * (s - vi), -1, 1) - V_RATE * V_DECAY * vi
    lw = np.where(np.abs(z) <= W_ONE, 0, (np.sign(z) * W_ONE - z) / ((1 + np.sqrt(squares)) / W_RATE + W_TWO))
    return Machine(bias, used, lw.astype("f4"), lv.astype("f4"))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine learned from at most 2 * sample labelled rows, in one task; the driver gets the weights of the terms that have any."""
    rows, prior = training_rows(documents, labels, "toxic", sample)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += texts_of(batch)
            y += batch.column("label").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: xxhash.xxh64_intdigest(texts[i]))
        m = train([texts[i] for i in order], [y[i] for i in order], prior)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.ids.astype("<i4").tobytes()], pa.binary()), pa.array([m.w.astype("<f4").tobytes()], pa.binary()), pa.array([m.v.astype("<f4").tobytes()], pa.binary())], ["bias", "ids", "w", "v"])

    # the sample is written first, so that one task reads no more than it
    got = rows.coalesce(1).mapInArrow(learn, "bias double, ids binary, w binary, v binary").collect()
    if not got:
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    return Machine(got[0]["bias"], np.frombuffer(got[0]["ids"], "<i4"), np.frombuffer(got[0]["w"], "<f4"), np.frombuffer(got[0]["v"], "<f4").reshape(-1, FACTORS))


def score(documents: DataFrame, machine: Machine, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document, from its whole text.

    A null text counts as empty; texts without words get the score of the bias alone; null ids and repeated rows stay, row by row;
    an empty table gives no rows; other columns of the input, whatever their names, are not read.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    model = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in groups_of(batches):
            margins = np.array([model.value.margin(term_ids(t, terms)) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))), pa.float64())], schema.names)

    scored = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored_like(documents: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text"):
    """A column: 1 if the text's score is at least threshold, else 0."""
    model = documents.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.IntegerType())
    def predicted(texts):
        import pandas as pd

        terms = Terms()
        cut = np.log(threshold / (1 - threshold))
        return pd.Series([int(model.value.margin(term_ids(t or "", terms)) >= cut) for t in texts], dtype="int32")

    return predicted(F.col(text_col).cast("string"))
