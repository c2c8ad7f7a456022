"""Tables in files: intermediate results in the shared folder, and versioned snapshots of a store."""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.sources.versions import Versions

QUESTIONS = "id bigint, stem_key string, stem_raw string, stem_norm string, qtype string, options array<string>, answer string, answer_text string, explanation string, source string, first_seen timestamp, last_seen timestamp, times_seen bigint, right_count bigint, wrong_count bigint"
CAPTURES = "batch_id bigint, seq bigint, source string, stem string, options array<string>, answer string, qtype string, explanation string, seen_at timestamp"
ATTEMPTS = "attempt_id bigint, stem_key string, given string, ok boolean"
TOMBSTONES = "stem_key string, batch_id bigint"
#: Captures with what a fold needs to know of them.
PREPARED = f"{CAPTURES}, stem_norm string, kept boolean, stem_key string, answer_text string"
#: Questions as they stand, without the counts of attempts.
STANDING = "id bigint, stem_key string, stem_raw string, stem_norm string, qtype string, options array<string>, answer string, answer_text string, explanation string, source string, first_seen timestamp, last_seen timestamp, times_seen bigint, first_batch bigint, first_seq bigint"
POSTINGS = "id binary, bucket int, key bigint, s string"
CONFLICTS = "stem_key string, stem_raw string, old_answer string, new_answer string, source string, seen_at timestamp, batch_id bigint, seq bigint"
#: Buckets of a new bank's questions. A bank keeps its number; some hundred MB a bucket are a good size.
BUCKETS = 64


class Workspace:
    """Writes intermediate tables where every executor can read them, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        root = root or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="stemforge-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Asks the driver to let go of the shuffle files of steps that are done. It does so when it collects garbage, which a driver with little
        to do may put off until the query's end; between large steps they would add up."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def spread(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """rows dealt anew by keys where the scan they come from has fewer parts than the cluster has cores; on many files as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, *keys) if source.rdd.getNumPartitions() < cores else rows


class Store:
    """A bank's files: captures as they came, questions as they stand, and logs of conflicts, attempts and tombstones.

    Captures lie in one folder per batch and questions in buckets by a hash of their normal stem, captures within a batch too; what is
    current is told by the last version (see Versions), so a batch becomes visible whole or not at all, and a change writes the buckets
    that it touches anew, under new names. Files that no kept version names are left for vacuum.

    Batches of all writers share one order: claim() gives a writer's batch its number, and the same number when the writer comes again
    with it. A number is taken by creating a file of that name, which one writer only can do (on file systems that create files
    atomically)."""

    TABLES = {"captures": CAPTURES, "attempts": ATTEMPTS, "tombstones": TOMBSTONES}

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions, self._buckets = Versions(spark, self.root), buckets

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        path, fs = self._path(*names)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    # --- the order of batches

    def _claimed(self, number: int) -> bool:
        path, fs = self._path("batches", "numbers", str(number))
        return fs.exists(path)

    def last_batch(self) -> int:
        """The largest number of a batch; -1 if there is none. Numbers have no gaps, so a few are looked at and none is listed."""
        if not self._claimed(0):
            return -1
        high = 1
        while self._claimed(high):
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._claimed(middle) else (low, middle)
        return low

    def claim(self, writer: str, batch: int | str) -> int:
        """The number of a writer's batch among the batches of all writers."""
        owner = ("batches", "writers", quote(writer, safe=""), quote(str(batch), safe=""))
        for name in self._names(*owner):
            return int(name)
        number = self.last_batch() + 1
        while True:
            path, fs = self._path("batches", "numbers", str(number))
            if fs.createNewFile(path):
                break
            number += 1
        path, fs = self._path(*owner, str(number))
        fs.createNewFile(path)
        return number

    # --- the state

    def state(self) -> tuple[int, dict]:
        """The last version: its number, and buckets (how many), next_id, through (the last batch folded or hidden), and the folders of
        batches, conflicts and the index of stems (by batch) and questions (by bucket)."""
        version, state = self.versions.latest()
        return version, state or {"buckets": self._buckets, "next_id": 1, "through": -1, "batches": {}, "conflicts": {}, "questions": {}, "index": {}}

    def write_buckets(self, name: str, rows: DataFrame) -> tuple[str, list[int]]:
        """rows (with bucket) in a new folder, by bucket; the folder's name and its buckets. Files are of even size, a hot bucket in many."""
        folder = f"run={uuid.uuid4().hex}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        return folder, sorted(int(n[7:]) for n in self._names(name, folder) if n.startswith("bucket="))

    def write_rows(self, name: str, rows: DataFrame) -> str:
        folder = f"run={uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def questions(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """The questions as they stand, of all buckets or only from the files of some."""
        at = (state or self.state()[1])["questions"]
        paths = [f"{self.root}/questions/{folder}/bucket={b}" for b, folder in at.items() if buckets is None or int(b) in set(buckets)]
        return self._of(paths, STANDING)

    def captures(self, buckets: list[int] | None = None, state: dict | None = None, without: int | None = None) -> DataFrame:
        """The captures of all batches (but one) with their normal forms and keys, of all buckets or only from the files of some."""
        at = (state or self.state()[1])["batches"]
        rows = self.runs([folder for n, folder in at.items() if int(n) != without])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def runs(self, folders: list[str]) -> DataFrame:
        """The captures in some folders, with their buckets."""
        rows = self._of([f"{self.root}/captures/{f}" for f in folders], f"{PREPARED}, bucket int, run string", f"{self.root}/captures")
        return rows.drop("run")

    def conflicts(self) -> DataFrame:
        return self._of([f"{self.root}/conflicts/{f}" for f in self.state()[1]["conflicts"].values()], CONFLICTS)

    def index(self, state: dict | None = None) -> DataFrame:
        """The postings of all stems (see operators.index)."""
        return self._of([f"{self.root}/index/{f}" for f in (state or self.state()[1])["index"].values()], POSTINGS)

    def _of(self, paths: list[str], schema: str, base: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- logs

    def _stored(self, name: str, rows: DataFrame) -> DataFrame:
        fields = [f.split(" ")[0] for f in self.TABLES[name].split(", ")]
        return rows.select(*(F.col(f) for f in fields)).to(self.spark.createDataFrame([], self.TABLES[name]).schema)

    def read(self, name: str) -> DataFrame:
        """A table's rows; an absent one is empty. Captures are those of visible batches."""
        fields = [f.split(" ")[0] for f in self.TABLES[name].split(", ")]
        if name == "captures":
            return self.captures().select(*fields)
        path, fs = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.root}/{name}").select(*fields)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to attempts or tombstones; captures come in by batch."""
        if name == "captures":
            raise ValueError("captures are stored by batch: use claim and upkeep.learn_batch")
        self._stored(name, rows).write.mode("append").parquet(f"{self.root}/{name}")

    def snapshot(self, questions: DataFrame, stamp: str) -> str:
        """A copy of questions under a new name, as a backup before a deletion."""
        path = f"{self.root}/snapshots/{stamp}-{uuid.uuid4().hex[:8]}"
        questions.write.parquet(path)
        return path

    def vacuum(self) -> int:
        """Deletes the folders that no kept version names, and says how many. Only while no other writer is at work: what it has prepared is not
        named yet either."""
        named = self.versions.named()
        gone = 0
        for name in ("captures", "questions", "conflicts", "index"):
            for folder in self._names(name):
                if folder not in named:
                    path, fs = self._path(name, folder)
                    gone += bool(fs.delete(path, True))
        return gone


def export_rows(questions: DataFrame) -> DataFrame:
    """id, stem, options, answer, answer_text, explanation, times_seen and wrong_count, by id."""
    return questions.select("id", F.col("stem_raw").alias("stem"), F.coalesce("options", F.array().cast("array<string>")).alias("options"), "answer", "answer_text", "explanation", "times_seen", "wrong_count").orderBy("id")


def export_json(questions: DataFrame, path: str) -> None:
    """One JSON object per line, nulls included."""
    export_rows(questions).write.option("ignoreNullFields", "false").json(path)


def export_document(questions: DataFrame, path: str) -> None:
    """The questions as one JSON array: a folder of files that, one after the other in the order of their names, make up an indented
    document. Each file holds a range of ids and is written by its own task."""
    rows = export_rows(questions)
    ends = rows.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    if ends["first"] is None:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    body = F.regexp_replace(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}), "(?m)^", "  ")
    opens = F.when(F.col("id") == ends["first"], "[\n").otherwise("")
    closes = F.when(F.col("id") == ends["last"], "\n]").otherwise(",")
    rows.select(F.concat(opens, body, closes).alias("value")).write.text(path)


def merge_files(spark: SparkSession, folder: str, path: str) -> None:
    """Copies a folder's data files, in the order of their names, into one file, as a stream of bytes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path))
    fs, out_fs = source.getFileSystem(conf), target.getFileSystem(conf)
    out = out_fs.create(target, True)
    try:
        for name in sorted(f.getPath().getName() for f in fs.listStatus(source)):
            if name.startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
