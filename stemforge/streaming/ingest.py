"""Papers that arrive as files, learned batch by batch."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemforge.bank import captures_of, parsed_batch
from stemforge.operators.parse import parse_blocks
from stemforge.operators.upkeep import learn_batch
from stemforge.sources.papers import paper_blocks
from stemforge.sources.tables import Store, Workspace

#: The columns of Spark's binary files; a stream of text files would cut them into lines.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def paper_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(paper_id, text) of the UTF-8 text files that arrive in a folder, one paper each; paper_id is a hash of the file's path."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.pmod(F.xxhash64("path"), F.lit(1 << 42)).alias("paper_id"), F.col("content").cast("string").alias("text"))


def ingest(papers: DataFrame, store: Store, checkpoint: str, source: str = "stream", **trigger) -> StreamingQuery:
    """papers: a stream of papers (paper_id, text), or of their lines (paper_line_stream), whose papers may be of any size. Folds the questions of each micro-batch into the store's. The checkpoint names the writer: a batch that runs again after
    a failure replaces what it had written, so each paper is learned once, and streams with other checkpoints, and papers learned
    otherwise, keep their own batches."""
    writer = f"stream-{hashlib.md5(checkpoint.rstrip('/').encode(), usedforsecurity=False).hexdigest()}"

    def learn(batch: DataFrame, batch_id: int) -> None:
        number = store.claim(writer, batch_id)
        space = Workspace(store.spark)
        parsed = parsed_batch(batch, space) if "text" in batch.columns else space.table(parse_blocks(space.table(paper_blocks(batch), "blocks")), "parsed")
        learn_batch(store, number, captures_of(parsed, number, source, datetime.now().replace(microsecond=0)), space)

    return papers.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
