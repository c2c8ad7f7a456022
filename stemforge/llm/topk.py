"""Exact top-k by inner product, block at a time.

A vector counts as a document and its components as terms, the positive and the negative part of each apart. Blocks are ranges
of documents in an order that puts similar vectors side by side, with a forward index (the rows of the block) and each term's
maximum; neighbouring blocks make a segment. The sum of a query's weights times the term maxima bounds every score in a block or
segment. A query's first floor is the k-th best score in its own block, its second that in its best-bounded segment. Only the
segments whose bounds reach the floor are sent to a query's task, which orders the blocks by their bounds and scores whole blocks
until the next bound is below the k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.llm.shared import Scratch

SCALE = 1024
BLOCK_ROWS, SEGMENT_BLOCKS, QUERY_ROWS = 256, 32, 512
#: A block or segment ends, with fewer rows or blocks, once its forward index takes so many bytes: long vectors make short blocks.
BLOCK_BYTES, SEGMENT_BYTES = 1 << 17, 1 << 22
#: Segments whose bounds one task computes for a group of queries.
BOUNDED_SEGMENTS = 1024
#: Random directions whose signs order the vectors.
DIRECTIONS = 12
#: Sums below this are exact in doubles.
EXACT = 2**52


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles without fractions; null if the vector is null or has a component that is null or
    not finite, or that isn't once it is scaled."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    # from 2**52 on doubles have no fractions
    return F.when(good, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(float(EXACT)), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))))


def matrix(rows: list, dims: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with 0, which adds nothing to a product."""
    dims = max([dims or 0, *map(len, rows)])
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def integers(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.reshape(-1).tolist()], object).reshape(m.shape)


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where no sum can exceed EXACT, else in Python's integers."""
    d = min(queries.shape[1], block.shape[1])
    q, b = queries[:, :d], block[:, :d]
    if d == 0 or float(np.abs(q).max(initial=0)) * float(np.abs(b).max(initial=0)) * d < EXACT:
        return (q @ b.T).astype(np.int64)
    return np.clip(integers(q) @ integers(b).T, -(2**63), 2**63 - 1)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over terms of weight times maximum: an upper bound of its products with the block's rows."""
    pad = lambda m: np.pad(m, ((0, 0), (0, max(0, queries.shape[1] - m.shape[1]))))[:, : queries.shape[1]].astype("f8")
    q = queries.astype("f8")
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.maximum(q, 0) @ np.maximum(pad(high), 0).T + np.maximum(-q, 0) @ np.maximum(-pad(low), 0).T
    return np.nan_to_num(top, nan=np.inf) * (1 + 1e-12) + 1e-6


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, by falling score and rising id."""
    if len(ids) > 4 * k and scores.dtype != object:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return scores[order], ids[order]


BLOCK_SCHEMA = "block long, segment long, rows int, dims int, ids binary, numbers binary, forward binary, high binary, low binary"


def code(v: Column) -> Column:
    """The signs of a vector's products with DIRECTIONS random ones, as bits of an integer."""
    signs = np.random.default_rng(3).choice([-1.0, 1.0], (DIRECTIONS, 64)).tolist()

    def side(s: list[float]) -> Column:
        table = F.array(*map(F.lit, s))
        terms = F.transform(v, lambda x, j: x * F.element_at(table, (j % 64 + 1).cast("int")))
        return (F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) > 0).cast("int")

    bits = F.lit(0)
    for s in signs:
        bits = bits * 2 + side(s)
    return bits


def blocks_of(vectors: DataFrame, every: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The blocks of vectors (number, vec_id, v, code), written, and a floor for the k-th best score of queries that their own
    block gives."""
    ordered = vectors.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id").drop("code")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = segment = TaskContext.get().partitionId() << 32
        widest = blocks = held = 0
        ids: list[int] = []
        numbers: list[int] = []
        rows: list = []

        def made() -> pa.RecordBatch:
            m = matrix(rows)
            own, own_numbers = np.array(ids, np.int64), np.array(numbers, np.int64)
            floors = []
            for i in np.flatnonzero(own % every == 0):
                s = np.delete(products(m[i : i + 1], m)[0], i)
                if len(s) >= k:
                    floors.append((int(own_numbers[i]), int(best(s, np.delete(own, i), k)[0][-1])))
            high, low = m.max(0), m.min(0)
            cells = [block, segment, len(ids), m.shape[1], own.tobytes(), own_numbers.tobytes(), m.tobytes(), high.tobytes(), low.tobytes(), [f[0] for f in floors], [f[1] for f in floors]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["block", "segment", "rows", "dims", "ids", "numbers", "forward", "high", "low", "queries", "floors"])

        for batch in batches:
            for number, i, v in zip(*(batch.column(c).to_pylist() for c in ("number", "vec_id", "v"))):
                ids.append(i)
                numbers.append(number)
                rows.append(v)
                widest = max(widest, len(v))
                if len(ids) == BLOCK_ROWS or 8 * widest * len(ids) >= BLOCK_BYTES:
                    yield made()
                    blocks, held = blocks + 1, held + 8 * widest * len(ids)
                    if blocks == SEGMENT_BLOCKS or held >= SEGMENT_BYTES:
                        segment, blocks, held = segment + 1, 0, 0
                    block, widest, ids, numbers, rows = block + 1, 0, [], [], []
        if ids:
            yield made()

    blocks = scratch.table(ordered.mapInArrow(build, f"{BLOCK_SCHEMA}, queries array<long>, floors array<long>"), "blocks")
    floors = blocks.select(F.explode(F.arrays_zip("queries", "floors")).alias("z")).select(F.col("z.queries").alias("number"), F.col("z.floors").alias("floor"))
    return blocks.drop("queries", "floors"), floors


def segments_of(blocks: DataFrame) -> DataFrame:
    """segment, high, low: the term maxima and minima of neighbouring blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, high, low = None, [], []
        for batch in batches:
            for g, h, w in zip(*(batch.column(c).to_pylist() for c in ("segment", "high", "low"))):
                segment = g
                high.append(np.frombuffer(h))
                low.append(np.frombuffer(w))
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([matrix(high).max(0).tobytes()], pa.binary()), pa.array([matrix(low).min(0).tobytes()], pa.binary())], ["segment", "high", "low"])

    return blocks.select("segment", "high", "low").groupBy("segment").applyInArrow(run, "segment long, high binary, low binary")


def read_matrix(t: pa.Table, name: str) -> np.ndarray:
    return matrix([np.frombuffer(x) for x in t.column(name).to_pylist()])


def promising(queries: DataFrame, segments: DataFrame, n_queries: int, n_segments: int) -> DataFrame:
    """number, segment, bound of the segments that may hold a score of a query's floor or more. Queries in groups and segments in
    groups meet once each, in a cell of bounded size; only term maxima are sent, no vectors but the queries' own."""
    groups, parts = -(-n_queries // QUERY_ROWS), -(-n_segments // BOUNDED_SEGMENTS)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("number", "v", "floor").withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")).withColumn("p", spread(parts))
    right = segments.withColumn("p", F.pmod(F.xxhash64("segment"), F.lit(parts)).cast("int")).withColumn("g", spread(groups))

    def cell(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["number", "segment", "bound"])
        top = bounds(matrix(q.column("v").to_pylist()), read_matrix(b, "high"), read_matrix(b, "low"))
        least = np.array([-np.inf if f is None else f for f in q.column("floor").to_pylist()])
        i, j = np.nonzero(top >= least[:, None])
        return pa.table([pa.array(q.column("number").to_numpy()[i]), pa.array(b.column("segment").to_numpy()[j]), pa.array(top[i, j])], ["number", "segment", "bound"])

    return left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInArrow(cell, "number long, segment long, bound double")


def scored(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """number, vec_id, score: the k best of each query (number, v, floor) in each segment that pairs (number, segment) name, by falling
    score and rising id; those below the floor may be missing. A segment with many queries is sent once for QUERY_ROWS of them."""
    sizes = pairs.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("groups"))
    left = pairs.select("number", "segment").join(sizes, "segment").withColumn("g", F.pmod(F.xxhash64("number"), F.col("groups")).cast("int")).drop("groups").join(queries.select("number", "v", "floor"), "number")
    right = blocks.join(sizes, "segment").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def cell(q: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and b.num_rows:
            qs, own, floor = matrix(q.column("v").to_pylist()), q.column("number").to_numpy(), q.column("floor").to_pylist()
            dims, rows = b.column("dims").to_pylist(), b.column("rows").to_pylist()
            read = lambda name, i: np.frombuffer(b.column(name)[i].as_py(), np.int64)
            top = bounds(qs, read_matrix(b, "high"), read_matrix(b, "low"))
            found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
            least = np.array([-np.inf if f is None else f for f in floor])
            order = np.argsort(-top, axis=1)
            # in step n, the queries that go on take their n-th block; those with the same block share one product
            for n in range(b.num_rows):
                chosen = order[:, n]
                going = np.flatnonzero(top[np.arange(len(own)), chosen] >= least)
                if not len(going):
                    break
                for i in np.unique(chosen[going]):
                    some = going[chosen[going] == i]
                    ids, numbers = read("ids", i), read("numbers", i)
                    scores = products(qs[some], np.frombuffer(b.column("forward")[i].as_py()).reshape(rows[i], dims[i]))
                    for row, j in enumerate(some):
                        others = numbers != own[j]
                        s, d = best(np.concatenate([found[j][0], scores[row][others]]), np.concatenate([found[j][1], ids[others]]), k)
                        found[j] = (s, d)
                        if len(s) == k and s[-1] > least[j]:
                            least[j] = float(s[-1])
            out = [(int(own[j]), int(d), int(s)) for j, (ss, dd) in enumerate(found) for s, d in zip(ss, dd)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["number", "vec_id", "score"])

    return left.groupBy("segment", "g").cogroup(right.groupBy("segment", "g")).applyInArrow(cell, "number long, vec_id long, score long")


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, the k rows of the highest inner product.

    Components count as floor(scale * x). Ties go to the smaller id; a query isn't its own candidate, but other rows are, equal
    vectors and rows that repeat its id included; each of several rows with an id divisible by every is a query. Rows with a null id
    or vector, or with a null or not finite component, take no part, nor do those with one that isn't finite once it is
    scaled. Scores beyond a long are held at its ends. Vectors of different length are multiplied over the common positions; empty
    vectors score 0. With k or fewer candidates all are returned; an empty table gives no rows; other columns are not read.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")).where("vec_id is not null and v is not null")
    v = scratch.table(v.select(F.monotonically_increasing_id().alias("number"), "vec_id", "v", code(F.col("v")).alias("code")), "vectors")
    blocks, floors = blocks_of(v, every, k, scratch)
    segments = scratch.table(segments_of(blocks), "segments")
    asked = v.where(F.col("vec_id") % every == 0).select("number", "vec_id", "v")
    n_segments, n_queries = segments.count(), asked.count()
    if not n_segments or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = scratch.table(asked.join(floors, "number", "left"), "queries")
    pairs = scratch.table(promising(queries, segments, n_queries, n_segments), "pairs")
    # the best-bounded segment of each query gives it a higher floor for the rest
    first = scratch.table(pairs.groupBy("number").agg(F.max(F.struct("bound", "segment"))["segment"].alias("segment")), "first")
    found = scratch.table(scored(first, queries, blocks, k), "found")
    raised = found.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    queries = queries.join(raised, "number", "left").select("number", "v", F.greatest("floor", "least").alias("floor"))
    queries = scratch.table(queries, "queries")
    rest = pairs.join(first, ["number", "segment"], "left_anti").join(queries.select("number", "floor"), "number").where("floor is null or bound >= floor")
    both = found.unionByName(scored(scratch.table(rest.select("number", "segment"), "rest"), queries, blocks, k))
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    ranked = both.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(asked.select("number", F.col("vec_id").alias("query_id")), "number").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
