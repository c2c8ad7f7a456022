"""The bounded sample of labelled rows that classifiers learn from, and the folds they must not see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.llm.shared import crc_fold, written

#: Labelled rows that a classifier learns from, at most, of each label.
SAMPLE = 3000
#: Rows of this remainder of crc32(doc_id) modulo FOLDS are never learned from.
HELD_OUT, FOLDS = 0, 5


def held_out(doc_id):
    return crc_fold(doc_id, FOLDS) == HELD_OUT


def training_rows(documents: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """A written table (text, label) of at most sample documents of each label, by a hash of the id, and the share of label 1 among all labelled rows
    that may be learned from (0.5 without any).

    Only rows outside the held-out fold with a label 0 or 1 and a doc_id count. An id that is labelled more than once counts as
    1 if any row says so, one that several documents have gives its least text. The sample's bound, not the input, sets the size of what is joined.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    mean = known.agg(F.avg("label")).first()[0]
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # 2 * sample rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return written(rows.select("text", "label"), "training"), 0.5 if mean is None else float(mean)
