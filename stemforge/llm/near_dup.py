"""MinHash near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles of five words.

The nodes are distinct texts (by MD5), so exact copies cost one row each and never meet as pairs. Each node gets SAMPLES weighted
samples in bands (see banding); nodes that share all samples of a band meet in its bucket, whose leader is the member that meets
most others.
Links are found in three rounds, and after each the linked nodes are contracted to one class:

1. every node is compared exactly (weighted Jaccard) with the best leader of its buckets, which settles nearly all of a group;
2. nodes whose class still differs from that of another leader of their buckets are compared with that one;
3. the nodes of buckets that still hold several classes meet by a prefix filter: similar texts share one of both texts' rarest
   shingles, at a place from which on either has weight enough, and have weights alike. Only pairs of different classes are made.

No bucket and no group has a cap, and none is gathered in one task: a leader with many members is dealt over several groups, and so
are the rows of a bucket with many members wherever they are joined.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.shared import Scratch, groups_of, texts_of, word_hashes

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
#: Samples of a text, and the share of pairs at the threshold that may share no band of them.
SAMPLES, LOSS = 80, 4e-5
#: Document frequencies are counted in 2**DF_BITS buckets of shingles, by the share of documents; what a bucket holds by chance
#: is a share too (distinct shingles of a mean document / buckets), so the weights are alike at every size of corpus.
DF_BITS, DF_BLOCKS = 20, 64
#: A shingle in one document of RARE or fewer has the full weight 1 + IDF_GAIN, one in every document the weight 1.
RARE, IDF_GAIN, LEVELS = 1024, 1.0, 16
#: Least hashes by which copies of one text are told, and the share of all documents from which a group of them counts as one.
SKETCHES, FAMILY = 3, 4096
FAMILY_UNIT = 1 << 16
#: Neighbouring tasks whose counts are added up first, so that no task reads those of all.
COUNTED_TASKS = 1024
#: Members of one leader that are compared in one group.
SPLIT = 256
#: A key is hot that has one in HOT of all rows; there are HOT such keys at most.
HOT = 4096
#: Steps of the texts' weights by which they are dealt in the prefix join.
STEP = 1.04
POOL_BITS = 16
FNV = np.uint64(0x100000001B3)
ROUNDING = 1e-9


def banding(threshold: float) -> tuple[int, int]:
    """Bands and samples in each: as many samples as leave (1 - threshold ** samples) ** bands, the share of pairs at the threshold that
    meet in no band, at LOSS or less. At 0.8 these are 20 bands of 4, which lose 3e-5; at 0.5 40 of 2, which lose 1e-5."""
    fits = [r for r in range(1, SAMPLES + 1) if (1 - threshold**r) ** (SAMPLES // r) <= LOSS]
    if not 0 < threshold <= 1 or not fits:
        raise ValueError(f"a similarity of {threshold} can't be searched with {SAMPLES} samples")
    return SAMPLES // max(fits), max(fits)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in order, repeats included; of fewer words than SHINGLE, one of them all."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out * FNV) ^ mixed(h[i : len(words) - n + 1 + i] + np.uint64(i))
    return mixed(out)


def stored(h: np.ndarray) -> np.ndarray:
    """The 32 bits of a shingle that are kept, sorted; their first DF_BITS choose its bucket of frequencies."""
    return np.sort((h >> np.uint64(32)).astype("<u4"))


def buckets_of(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint32(32 - DF_BITS)


def sketch(kept: np.ndarray) -> list[int]:
    """The least of a text's shingles under each of SKETCHES hashes: what copies with a few changes nearly always share."""
    return [k << 32 | int(((kept * np.uint32(m)) ^ (kept >> np.uint32(15))).min()) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))] if len(kept) else []


def shingled(texts: DataFrame) -> DataFrame:
    """doc_id, row (a number), node (MD5 of the text), kept (the stored shingles) and sketch of every document."""
    schema = T.StructType([texts.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("kept", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in groups_of(batches):
            nodes, kept, sketches = [], [], []
            for text in texts_of(batch):
                k = stored(shingles(text))
                nodes.append(hashlib.md5(text.encode(), usedforsecurity=False).digest())
                kept.append(k.tobytes())
                sketches.append(sketch(k))
            numbers = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), numbers, pa.array(nodes, pa.binary()), pa.array(kept, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], schema.names)

    return texts.mapInArrow(run, schema)


def families(rows: DataFrame, n: int) -> dict[int, int]:
    """Sketch -> documents that have it, of those that 1 / FAMILY of all n documents have: SKETCHES * FAMILY at most."""
    counts = rows.select(F.explode("sketch").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return {r["s"]: r["n"] for r in counts.where(F.col("n") >= max(2, -(-n // FAMILY))).collect()}


def document_frequencies(rows: DataFrame, large: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """By bucket of shingles, the documents that have one, and their number where the copies of one text (large: see families) count
    as one document: counts over all documents, of a fixed size."""
    known = rows.sparkSession.sparkContext.broadcast(large)

    def narrow(counts: np.ndarray) -> bytes:
        return counts.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if counts.max() <= np.iinfo(k).max)).tobytes()

    def unpacked(counts: bytes) -> np.ndarray:
        return np.frombuffer(counts, f"<u{len(counts) * DF_BLOCKS >> DF_BITS}").astype(np.int64)

    def batch_of(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["kind", "block", "part", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, copies, shares = (np.zeros(2**DF_BITS, k) for k in ("<u4", "<u4", "<u8"))
        some = False
        for batch in groups_of(batches, "kept"):
            for k, sketches in zip(batch.column("kept").to_pylist(), batch.column("sketch").to_pylist()):
                if not k:
                    continue
                some = True
                at = np.unique(buckets_of(np.frombuffer(k, "<u4")))
                # two of the sketches must say so: one alone may come from a passage that many texts hold
                if (many := sorted(known.value.get(s, 0) for s in sketches)[-2:][0]) > 1:
                    copies[at] += 1
                    shares[at] += np.uint64(round(FAMILY_UNIT / many))
                else:
                    seen[at] += 1
        if some:
            part = TaskContext.get().partitionId() // COUNTED_TASKS
            yield batch_of([(kind, b, part, narrow(x)) for kind, counts in enumerate((seen, copies, shares)) for b, x in enumerate(np.split(counts, DF_BLOCKS)) if x.any()])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, None
        for batch in batches:
            for *key, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "part", "counts"))):  # noqa: B007
                out = unpacked(counts) + (0 if out is None else out)
        if out is not None:
            yield batch_of([(*key, narrow(out))])

    schema = "kind int, block int, part int, counts binary"
    by_part = rows.select("kept", "sketch").mapInArrow(count, schema).groupBy("kind", "block", "part").applyInArrow(total, schema)
    found = by_part.groupBy("kind", "block").applyInArrow(total, schema).collect()
    seen, copies, shares = np.zeros((3, DF_BLOCKS, 2**DF_BITS // DF_BLOCKS), np.int64)
    for r in found:
        (seen, copies, shares)[r["kind"]][r["block"]] = unpacked(r["counts"])
    return (seen + copies).reshape(-1), (seen + shares / FAMILY_UNIT).reshape(-1)


def weight_codes(counts: np.ndarray, n: int) -> np.ndarray:
    """The level of each bucket of shingles, by its share of n documents beyond twice what a bucket holds by chance."""
    excess = np.maximum(counts - 2 * counts.sum() / len(counts), 0) / max(n, 1)
    idf = -np.log(np.maximum(excess, 1 / RARE)) / np.log(RARE)
    return np.rint(np.clip(idf, 0, 1) * (LEVELS - 1)).astype(np.uint8)


def level_weights() -> np.ndarray:
    return 1 + np.arange(LEVELS) * (IDF_GAIN / (LEVELS - 1))


@functools.lru_cache(1)
def pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The random variates of ICWS, r, c ~ Gamma(2, 1) and beta ~ U(0, 1), as rows (1/r, r, beta, log c - r), a sample's multipliers,
    and for every level's weight and row the log a and t of a shingle that occurs once. A sample of a shingle takes the row at
    a place that depends on both."""
    random = np.random.default_rng(20)
    r, c, beta = random.gamma(2, 1, 2**POOL_BITS), random.gamma(2, 1, 2**POOL_BITS), random.random(2**POOL_BITS)
    multipliers = random.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    variates = np.stack([1 / r, r, beta, np.log(c) - r]).astype("f4")
    t = np.floor(variates[0] * np.log(level_weights())[:, None].astype("f4") + variates[2])
    return variates, multipliers, (variates[3] - (t - variates[2]) * variates[1]).reshape(-1), t.astype(np.int16).reshape(-1)


def samples(tokens: np.ndarray, tf: np.ndarray, levels: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the distinct token with the least log a, and its t; a token's weight is tf times that of its level."""
    variates, multipliers, log_as, steps_of = pool()
    k = np.arange(len(multipliers))
    best, at, steps = np.full(len(k), np.inf, "f4"), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)

    def take(log_a: np.ndarray, where: np.ndarray, t) -> None:
        j = log_a.argmin(1)
        better = log_a[k, j] < best
        best[better], at[better], steps[better] = log_a[k, j][better], where[j][better], t(j)[better]

    once, more = np.flatnonzero(tf == 1), np.flatnonzero(tf > 1)
    for start in range(0, len(once), chunk):
        some = once[start : start + chunk]
        place = tokens[some] * multipliers[:, None]
        place >>= np.uint32(32 - POOL_BITS)
        place += levels[some].astype(np.uint32) << np.uint32(POOL_BITS)
        take(log_as.take(place), some, lambda j: steps_of[place[k, j]])  # noqa: B023
    for start in range(0, len(more), chunk):
        some = more[start : start + chunk]
        place = (tokens[some] * multipliers[:, None]) >> np.uint32(32 - POOL_BITS)
        inverse, r, beta, rest = (v.take(place) for v in variates)
        t = np.floor(inverse * np.log(tf[some] * level_weights()[levels[some]]).astype("f4") + beta)
        take(rest - (t - beta) * r, some, lambda j: t[k, j])  # noqa: B023
    return tokens[at], steps


def band_keys(kept: np.ndarray, codes: np.ndarray, bands: int, size: int) -> np.ndarray:
    tokens, tf = np.unique(kept, return_counts=True)
    chosen, steps = samples(tokens, tf, codes[buckets_of(tokens)])
    s = mixed(chosen.astype(np.uint64) + mixed(steps.astype(np.uint64)))[: bands * size].reshape(bands, size)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(size):
        key = mixed(key * FNV + s[:, i])
    return key.view(np.int64)


def banded(rows: DataFrame, codes, threshold: float = THRESHOLD) -> DataFrame:
    """row and bands of the documents that have shingles; a text that a task has met before gets no row."""
    shape = banding(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in groups_of(batches, "kept"):
            at, bands = [], []
            for row, node, k in zip(*(batch.column(c).to_pylist() for c in ("row", "node", "kept"))):
                if k and node not in met:
                    met.add(node)
                    at.append(row)
                    bands.append(band_keys(np.frombuffer(k, "<u4"), codes.value, *shape).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["row", "bands"])

    return rows.select("row", "node", "kept").mapInArrow(run, "row long, bands array<long>")


class Weighted:
    """A text's distinct tokens and their weights."""

    def __init__(self, kept: bytes, codes: np.ndarray):
        self.tokens, tf = np.unique(np.frombuffer(kept, "<u4"), return_counts=True)
        self.each = level_weights()[codes[buckets_of(self.tokens)]]
        self.weights = self.each * tf
        self.total = float(self.weights.sum())

    def similarity(self, other: Weighted) -> float:
        """Weighted Jaccard: sum of the least over sum of the largest weights."""
        if not self.total:
            return 0.0
        place = np.minimum(np.searchsorted(self.tokens, other.tokens), len(self.tokens) - 1)
        common = float(np.minimum(self.weights[place], other.weights)[self.tokens[place] == other.tokens].sum())
        return common / (self.total + other.total - common)


def weighted_jaccard(a: np.ndarray, b: np.ndarray, codes: np.ndarray) -> float:
    return Weighted(a.tobytes(), codes).similarity(Weighted(b.tobytes(), codes))


def of_ids(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the shingles of their ids. Always by a sort-merge join: ids grow with the documents and are never broadcast."""
    return kept.join(rows.hint("merge"), "id")


def hot_keys(counts: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key, parts) of the keys of counts (key, n) that have one in HOT of all rows or more: HOT rows at most, however many rows there are,
    so this may be broadcast. parts: into how many groups a key's rows are to be dealt for none to hold more."""
    share = max(1, -(-(counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT))
    return scratch.table(counts.where(F.col("n") >= share).select(key, F.ceil(F.col("n") / share).cast("int").alias("parts")), "hot")


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows (with id) joined with facts, one row for each key. The rows of a hot key are dealt by their ids, and its fact goes to every
    group of them; hot keys are few, so facts hardly grow."""
    of_hot = lambda x: x.join(F.broadcast(hot), key, "left")
    left = of_hot(rows).withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    right = of_hot(facts).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right.hint("merge"), [key, "part"]).drop("part")


def verified(pairs: DataFrame, kept: DataFrame, codes, threshold: float, scratch: Scratch) -> DataFrame:
    """Those of the distinct pairs (leader, id) whose weighted Jaccard similarity is at least threshold; kept: id and kept.

    A leader's shingles are sent once for every SPLIT of its members, a member's once for each of its leaders."""
    sizes = scratch.table(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "sizes")
    groups = sizes.select("leader", F.ceil(F.col("n") / SPLIT).cast("int").alias("groups"))
    dealt = scratch.table(dealt_join(pairs, groups, "leader", hot_keys(sizes, "leader", scratch)).select("leader", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("g"), "id", F.lit(1).alias("member")), "dealt")
    heads = dealt.select("leader", "g", F.col("leader").alias("id"), F.lit(0).alias("member")).distinct()
    grouped = of_ids(kept, dealt.unionByName(heads)).repartition("leader", "g").sortWithinPartitions("leader", "g", "member")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in groups_of(batches, "kept"):
            good = []
            for i, (member, k) in enumerate(zip(batch.column("member").to_pylist(), batch.column("kept"))):
                text = Weighted(k.as_py(), codes.value)
                if not member:
                    head = text
                elif head.similarity(text) >= threshold:
                    good.append(i)
            chosen = pa.array(good, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("leader").take(chosen), batch.column("id").take(chosen)], ["a", "b"])

    links = scratch.table(grouped.select("leader", "id", "member", "kept").mapInArrow(run, "a long, b long"), "links")
    scratch.drop(dealt, sizes)
    return links


def prefixes(kept: DataFrame, codes, threshold: float, counts) -> DataFrame:
    """Rows (id, total, token, rest): a text's weight, its rarest tokens, and the weight from each on, which is threshold of all or more.

    Two texts that are similar by threshold have threshold * the larger weight in common. The first token that they share, in an
    order of all tokens, comes before all of that weight, so it's among these of either text. counts (broadcast) gives the order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "kept"):
            at, totals, tokens, rests = [], [], [], []
            for i, k in enumerate(batch.column("kept").to_pylist()):
                text = Weighted(k, codes.value)
                order = np.lexsort((text.tokens, counts.value[buckets_of(text.tokens)]))
                rest = np.cumsum(text.weights[order][::-1])[::-1]
                chosen = rest >= threshold * text.total * (1 - ROUNDING)
                at += [i] * int(chosen.sum())
                totals += [text.total] * int(chosen.sum())
                tokens += text.tokens[order][chosen].tolist()
                rests += rest[chosen].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(totals, pa.float64()), pa.array(tokens, pa.int64()), pa.array(rests, pa.float64())], ["id", "total", "token", "rest"])

    return kept.select("id", "kept").mapInArrow(run, "id long, total double, token long, rest double")


def prefix_pairs(rows: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (leader, id) of rows (id, label, size of the label's class, total, token, rest) of different labels that may be similar.

    What two texts have in common lies, for the first token that they share, in the rest of either; it must be threshold / (1 +
    threshold) of both weights. So a row asks for texts of a range of weights only, and rows of a token's largest class ask for none:
    of two classes one isn't the largest."""
    several = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.struct("size", "label"))["label"].alias("largest")).where("x <> y")
    dealt = scratch.table(rows.join(several.select("token", "largest"), "token"), "prefixes")
    step = lambda w: F.floor(F.log(w) / F.lit(float(np.log(STEP)))).cast("int")
    share = threshold / (1 + threshold) * (1 - ROUNDING)
    heaviest = F.col("rest") / F.lit(share) - F.col("total")
    asked = F.explode(F.sequence(step(threshold * (1 - ROUNDING) * F.col("total")), step(heaviest)))
    asks = dealt.where("label <> largest").select("token", asked.alias("step"), *(F.col(c).alias(f"own_{c}") for c in ("id", "label", "total", "rest")))
    fits = F.least("rest", "own_rest") >= F.lit(share) * (F.col("total") + F.col("own_total"))
    met = dealt.withColumn("step", step(F.col("total"))).join(asks, ["token", "step"]).where(fits & (F.col("label") != F.col("own_label")))
    pairs = scratch.table(met.select(F.least("id", "own_id").alias("leader"), F.greatest("id", "own_id").alias("id")).distinct(), "pairs")
    scratch.drop(dealt)
    return pairs


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id -> label, equal for connected ids of edges (a, b): least label of the neighbours and a jump to the label's label, until none
    changes."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = scratch.table(labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("now")), "labels")
        jump = step.select(F.col("id").alias("now"), F.col("now").alias("far"))
        done, labels = labels, scratch.table(step.join(jump, "now").select("id", F.least("now", "far").alias("label"), (F.least("now", "far") != F.col("was")).alias("moved")), "labels")
        scratch.drop(done, step)
        if labels.where("moved").isEmpty():
            scratch.drop(both)
            return labels.select("id", "label")


def label_of(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the label of a column's ids, which is the id itself for those that have none."""
    return rows.join(labels.select(F.col("id").alias(column), F.col("label").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def contracted(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (id, label of every node) after more edges: only the classes that these join are gone through again."""
    between = label_of(label_of(edges, labels, "a", "x"), labels, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(between, scratch)
    return scratch.table(label_of(labels.withColumnRenamed("label", "old"), joined, "old", "label").select("id", "label"), "labels")


def linked(nodes: DataFrame, shingles: DataFrame, codes, counts, threshold: float, scratch: Scratch, *done: DataFrame) -> DataFrame:
    """id -> label of the nodes (id, bands) that share a bucket with others: equal for those that links of threshold or more connect,
    where links are all pairs of a bucket that are so similar. shingles: id and kept of all nodes, at least; done: tables of
    scratch that nobody reads once these have been read."""
    keys = nodes.select("id", F.explode("bands").alias("key"))
    sizes = scratch.table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    hot = hot_keys(sizes, "key", scratch)
    shared = scratch.table(dealt_join(keys, sizes, "key", hot), "buckets")
    # leaders are the nodes that meet most others: the text that copies were made from, rather than any of the copies
    ranks = scratch.table(shared.groupBy("id").agg((-F.sum("n")).alias("rank")), "ranks")
    members = scratch.table(shared.join(ranks, "id").select("key", "id", "rank"), "members")
    scratch.drop(shared, sizes)
    first = members.groupBy("key").agg(F.min(F.struct("rank", "id")).alias("first"))
    led = scratch.table(dealt_join(members.select("key", "id"), first, "key", hot).select("key", "id", "first"), "led")

    kept = scratch.table(of_ids(shingles, ranks.select("id")).select("id", "kept"), "kept")
    scratch.drop(*done)
    best = led.groupBy("id").agg(F.min("first")["id"].alias("leader")).where("leader <> id")
    tested = scratch.table(best.select("leader", "id"), "pairs")
    own = ranks.select("id", F.col("id").alias("label"))
    labels = contracted(own, verified(tested, kept, codes, threshold, scratch), scratch)

    def by_bucket(labels: DataFrame) -> DataFrame:
        """The rows (key, id, label, leader, leader's label) of buckets that hold several classes."""
        rows = label_of(led.select("key", "id", F.col("first.id").alias("leader")), labels, "id", "label")
        several = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        return scratch.table(dealt_join(rows, several, "key", hot), "several")

    left = by_bucket(labels)
    if left.isEmpty():
        return labels
    whole, kept = kept, scratch.table(of_ids(kept, left.select("id").union(left.select("leader")).distinct()).select("id", "kept"), "kept")
    scratch.drop(whole)
    others = label_of(left.select("leader", "id", "label").where("leader <> id").distinct(), labels, "leader", "led").where("label <> led")
    again = scratch.table(others.select("leader", "id").join(tested, ["leader", "id"], "left_anti"), "pairs")
    if not again.isEmpty():
        labels = contracted(labels, verified(again, kept, codes, threshold, scratch), scratch)
        left = by_bucket(labels)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    rest = scratch.table(left.select("id", "label").distinct().join(sizes, "label"), "rest")
    scratch.drop(led, members, left)
    if not rest.isEmpty():
        own_prefix = prefixes(of_ids(kept, rest.select("id")), codes, threshold, counts).join(rest, "id")
        pairs = prefix_pairs(scratch.table(own_prefix, "prefixes"), threshold, scratch)
        labels = contracted(labels, verified(pairs, kept, codes, threshold, scratch), scratch)
    return labels


def near_duplicate_classes(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size (documents), node (the text's MD5)
    and class_key (a number of the class).

    Documents are in one class if their texts are equal or a chain of similar texts connects them. threshold: the weighted Jaccard
    similarity of links, any from 0.12 to 1 (see banding); a lower one finds copies with more edits, for more work. Words are compared without
    case; fewer than five words make one shingle. A null text counts as an empty one; texts without words are in a class only
    with equal texts. Null ids and repeated rows stay, row by row; class_id is null if all ids of a class are. An empty table
    gives no rows; other columns of the input, whatever their names, are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.table(shingled(texts), "shingles")
    n = rows.where(F.size("sketch") > 0).count()
    raw, families_once = document_frequencies(rows, families(rows, n))
    codes, counts = spark.sparkContext.broadcast(weight_codes(families_once, n)), spark.sparkContext.broadcast(np.minimum(raw, 2**32 - 1).astype(np.uint32))
    nodes = scratch.table(rows.groupBy("node").agg(F.min("row").alias("id")), "nodes")
    bands = scratch.table(banded(rows, codes, threshold), "bands")
    members = scratch.table(rows.select("doc_id", "node"), "documents")
    own = bands.join(nodes.select(F.col("id").alias("row")), "row", "left_semi").withColumnRenamed("row", "id")
    labels = linked(own, rows.select(F.col("row").alias("id"), "kept"), codes, counts, threshold, scratch, rows)
    label = label_of(nodes, labels, "id", "class_key").select("node", "class_key")
    found = scratch.table(members.join(label, "node"), "classes")
    scratch.keep(found)
    classes = found.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(classes, "class_key").select("doc_id", "class_id", "class_size", "node", "class_key")


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents with all their columns, one of each class: of the least doc_id, and of those the least text MD5.

    Null ids come last; of rows with the same id and text one stays; null and empty texts are a class of their own.
    """
    own = f"pick_{uuid.uuid4().hex}"

    def pick(node: Column, doc_id: Column) -> Column:
        """One key of a text and an id, so that the join and the removal of repeated rows share a shuffle."""
        return F.concat(node, F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).alias(own)

    classes = near_duplicate_classes(documents, threshold, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node"))
    chosen = classes.groupBy("class_key").agg(first.alias("m")).select(pick(F.lower(F.hex("m.node")), F.col("m.doc_id")))
    rows = documents.withColumn(own, pick(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")), F.col(id_col)))
    return rows.join(chosen, own, "left_semi").dropDuplicates([own]).drop(own)
