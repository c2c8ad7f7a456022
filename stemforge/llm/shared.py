"""Helpers that the operators of this package share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one set here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="stemforge-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in a folder of its own: dropped once later tables hold what they were for, so a run's disk stays bounded."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, new_dir(spark, "scratch"), {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the folder, read again."""
        path = f"{self.root}/{len(self.paths):03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def _delete(self, paths: list[str]) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.paths[p] = None

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        self._delete([p for p, t in self.paths.items() if any(t is x for x in tables)])

    def keep(self, *tables: DataFrame) -> None:
        """Removes all other tables."""
        self._delete([p for p, t in self.paths.items() if t is not None and not any(t is x for x in tables)])


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal digits, modulo folds; a null id counts as the text 'null'."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds).cast("int")


def hash_unit(*cols: Column) -> Column:
    """A number in (0, 1) from an MD5 of the columns' text, the same in every engine."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def groups_of(batches: Iterable[pa.RecordBatch], name: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most most_bytes of the named column, one row at least."""
    for batch in batches:
        sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() if isinstance(v, (pa.StringScalar, pa.BinaryScalar)) else None for v in batch.column(name))] if batch.num_rows and batch.column(name).nbytes > most_bytes else []
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


#: Words whose hashes a worker keeps: workers outlive stages, and what they keep adds up.
KEPT_WORDS = 100_000


class Chunks:
    """Arrays of one type one after the other in large pieces of memory, which go back to the system when they are done with."""

    def __init__(self, kind: str, size: int = 1 << 20):
        self.all, self.ends = np.empty(size, kind), [0]

    def add(self, part: np.ndarray) -> None:
        end = self.ends[-1] + len(part)
        if end > len(self.all):
            grown = np.empty(max(end, 2 * len(self.all)), self.all.dtype)
            grown[: self.ends[-1]] = self.all[: self.ends[-1]]
            self.all = grown
        self.all[self.ends[-1] : end] = part
        self.ends.append(end)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.all[self.ends[i] : self.ends[i + 1]]

    def __len__(self) -> int:
        return len(self.ends) - 1


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words met most lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@functools.lru_cache(1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    """The 64-bit hashes of words, the same in every process."""
    return np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
