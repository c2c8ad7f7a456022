"""Fingerprints of documents that add up: homomorphic multiset hashes of their paragraphs.

A paragraph (what lies between line feeds) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors
modulo powers of two. So the order of paragraphs doesn't matter, a paragraph is inserted or deleted by one addition or
subtraction, and the fingerprint of two texts joined by a line feed is the sum of theirs.

The vector has two parts. EXACT lanes of 64 bits (SHAKE-128 of the paragraph, modulo 2 ** 64) tell multisets of paragraphs apart. SKETCH
lanes of 16 bits (modulo 2 ** 16) hold a count sketch of what the paragraph says: its grams of GRAM code points, from every place
where a word begins or, beyond U+2E80, from every character, distinct within each SEGMENT code points of the paragraph, and the paragraph as a
whole; each adds 1 or -1 to one lane. Squared lengths and products of sketches estimate those of the counts, so likeness is
2 * a.b / (a.a + b.b), with a standard error of about 1 / sqrt(SKETCH).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.shared import groups_of, written

EXACT, SKETCH = 16, 256
GRAM, SEGMENT = 12, 1 << 16
#: The first code point of scripts that don't part words.
UNPARTED = 0x2E80
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)
#: Ranges of ids that documents are ordered in; their bounds are all that the driver sees of the ids.
RANGES = 4096


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on those of h."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


class Fingerprint:
    """A sum of paragraphs' vectors."""

    def __init__(self, exact: np.ndarray, sketch: np.ndarray):
        self.exact, self.sketch = exact, sketch

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        """The fingerprint of a text, all of whose paragraphs count, blank ones too; null: of no paragraph."""
        exact, sketch = np.zeros(EXACT, np.uint64), np.zeros(SKETCH, np.int64)
        if text is not None:
            paragraphs = text.encode("utf-8", "surrogatepass").split(b"\n")
            for start in range(0, len(paragraphs), 1 << 14):
                digests = b"".join(hashlib.shake_128(p).digest(8 * EXACT) for p in paragraphs[start : start + (1 << 14)])
                lanes = np.frombuffer(digests, "<u8").reshape(-1, EXACT)
                exact += lanes.sum(axis=0, dtype=np.uint64)
                sketch += signed_counts(mixed(lanes[:, 0]))
            sketch += gram_counts(text)
        return cls(exact, sketch.astype(np.uint16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and np.array_equal(self.exact, other.exact) and np.array_equal(self.sketch, other.sketch)

    __hash__ = None

    def __str__(self) -> str:
        return (self.exact.astype("<u8").tobytes() + self.sketch.astype("<u2").tobytes()).hex()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        data = bytes.fromhex(text)
        return cls(np.frombuffer(data, "<u8", EXACT).astype(np.uint64), np.frombuffer(data, "<u2", SKETCH, 8 * EXACT).astype(np.uint16))

    def likeness(self, other: Fingerprint) -> float:
        """How much of what both texts say they share, from 0 to 1: 1 for equal fingerprints, below 1 for others."""
        if np.array_equal(self.exact, other.exact):
            return 1.0
        a, b = (x.sketch.view(np.int16).astype(np.float64) for x in (self, other))
        size = float(a @ a + b @ b)
        return min(max(2 * float(a @ b) / size, 0.0), 1 - 2.0**-20) if size else 0.0


def signed_counts(hashes: np.ndarray) -> np.ndarray:
    """The count sketch of hashes: each adds 1 or -1 to a lane."""
    lane, sign = (hashes % np.uint64(SKETCH)).astype(np.int64), 1 - 2 * ((hashes >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
    return np.bincount(lane, sign, SKETCH).astype(np.int64)


def gram_counts(text: str) -> np.ndarray:
    """The count sketch of a text's grams, in windows of SEGMENT code points: a window's hashes are all that is held at once."""
    out, place = np.zeros(SKETCH, np.int64), 0
    held: list[str] = []
    size = 0
    # whole paragraphs run together up to a window's size; longer ones by segments, with the characters that grams reach into
    for paragraph in text.split("\n"):
        if len(paragraph) > SEGMENT:
            for place in range(0, len(paragraph), SEGMENT):
                begun = place == 0 or paragraph[place - 1].isspace()
                out += window_counts(paragraph[place : place + SEGMENT + GRAM - 1], SEGMENT, begun)
        elif len(paragraph) >= GRAM:
            held.append(paragraph)
            size += len(paragraph)
            if size > SEGMENT:
                out += window_counts("\n".join(held))
                held, size = [], 0
    return out + window_counts("\n".join(held)) if held else out


def window_counts(text: str, most: int | None = None, begun: bool = True) -> np.ndarray:
    """The count sketch of the grams that begin within most characters and cross no line feed, distinct within each paragraph.
    begun: whether a word may begin with the first character."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(chars) - GRAM + 1
    if n <= 0:
        return np.zeros(SKETCH, np.int64)
    n = min(n, most or n)
    feed = chars == 10
    space = (chars == 32) | ((chars >= 9) & (chars <= 13)) | (chars == 0xA0) | (chars == 0x3000)
    starts = chars[:n] >= UNPARTED
    starts[1:] |= space[: n - 1]
    starts[0] |= begun
    starts &= ~space[:n]
    paragraph = np.concatenate([[0], np.cumsum(feed)])
    starts &= paragraph[GRAM : GRAM + n] == paragraph[:n]
    at = np.flatnonzero(starts)
    h = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        h = h * MIX[2] + chars[at + j]
    h = mixed(h)
    # the same gram in another paragraph counts again
    key = h ^ mixed(paragraph[at].astype(np.uint64) * MIX[2])
    return signed_counts(h[np.unique(key, return_index=True)[1]])


def edited(text: str, following: str) -> tuple[str, Fingerprint, Fingerprint]:
    """A text with its second half replaced by as much of the beginning of the following text, and the fingerprints of the text
    and of that: what lies behind the last line feed of the first half is deleted from the former and inserted anew."""
    half = len(text) // 2
    cut = len(text) - half
    border = text.rfind("\n", 0, cut)
    kept = Fingerprint.of(text[:border] if border >= 0 else None)
    new = text[:cut] + following[:half]
    return new, kept + Fingerprint.of(text[border + 1 :]), kept + Fingerprint.of(new[border + 1 :])


def in_ranges(documents: DataFrame) -> DataFrame:
    """documents (doc_id, tie, text) with range, and guest: every range is followed by a guest, the first document of the next one (of the
    first one behind the last). Ranges hold about as many documents each, whatever the ids, all of an id in one; null ids come first."""
    share = F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 4 * RANGES)
    bounds = np.array(sorted(set(documents.agg(share.alias("q")).first()["q"] or [])), np.int64)

    @F.pandas_udf(T.IntegerType())
    def range_of(doc_id):
        import pandas as pd

        known = doc_id.notna()
        at = np.zeros(len(doc_id), np.int32)
        at[known.to_numpy()] = np.searchsorted(bounds, doc_id[known].to_numpy(np.int64), side="right")
        return pd.Series(at)

    rows = documents.withColumn("range", range_of("doc_id"))
    first = F.min(F.struct("doc_id", "tie")).alias("first")
    before = F.lag("range").over(Window.orderBy("range"))
    heads = written(rows.groupBy("range").agg(first), "heads")  # RANGES rows at most, by which the window and the broadcast are bounded
    last = F.lit(heads.agg(F.max("range")).first()[0])
    heads = heads.select(F.col("first.doc_id").alias("head_id"), F.col("first.tie").alias("head_tie"), F.coalesce(before, last).alias("to"))
    both = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    places = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("range"), F.lit(True).alias("guest")))
    own = F.slice(places, F.lit(1), F.when(F.col("to").isNull(), 1).otherwise(2))
    return both.select("doc_id", "tie", "text", F.explode(own).alias("place")).select("doc_id", "tie", "text", "place.*")


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document; the edited text has its
    last half replaced by as much of the next document's beginning, in the order of ids (see edited).

    Null texts count as empty: one blank paragraph. Null ids come before all others; rows of one id are ordered by a hash of their
    texts; repeated rows follow each other; a single document follows itself. An empty table gives no rows; other columns of the input,
    whatever their names, are not read. Texts are shuffled once, into ranges of ids that are sorted and read as a stream.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    sort = ["range", "guest", "doc_id", "tie"]
    ordered = in_ranges(rows).repartition("range").sortWithinPartitions(*sort)
    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType()}
    schema = T.StructType([T.StructField(k, t) for k, t in kinds.items()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text) that waits for the next text, and what is known of the last but one
        waiting: tuple | None = None
        with np.errstate(over="ignore"):
            for batch in groups_of(batches):
                out = []
                for where, guest, doc_id, own in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text"))):
                    if last and last[0] == where:
                        new, known, changed = edited(last[2], own)
                        row = (last[1], len(last[2]), hashlib.sha256(new.encode()).hexdigest(), str(known), str(changed), known.likeness(changed))
                        if waiting:
                            out.append((*waiting[0], waiting[1].likeness(known)))
                        waiting = (row, known)
                    if guest:
                        if waiting:
                            out.append((*waiting[0], waiting[1].likeness(Fingerprint.of(own))))
                        last = waiting = None
                    else:
                        last = (where, doc_id, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], schema.names)

    return ordered.select("range", "guest", "doc_id", "text").mapInArrow(run, schema)
