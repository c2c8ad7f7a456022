"""Mixing sources to target weights by Poisson replication.

A source of size S with target weight w gets the mean repetition rate w * total / S (size in UTF-8 bytes). Each document draws
its number of copies by inverting the Poisson distribution with that mean at a uniform number hashed from its id and text, so
a run gives the same copies wherever and however often its tasks run. Copies are shuffled over the whole result by a hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.shared import hash_unit, written

#: A mean above this is drawn as the sum of several Poisson numbers of equal means, each of this at most.
LARGEST_MEAN = 32.0
#: Bits of the hash that orders the copies.
ORDER_BITS = 60


def poisson_cdf(mean: Column) -> Column:
    """Chances of at most 0, 1, 2, ... for a mean of LARGEST_MEAN or less, until the rest is below 1e-16."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 12).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def rates(documents: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float | None = None, source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, float]:
    """source, size (bytes), documents, weight (target share) and rate (mean copies of a document) for every source; and the mix's bytes.

    weights: target weights by source (None is the null source), normalised over the sources that are there; a source without
    a weight gets 0. Without weights they are size ** alpha. total: bytes of the mix, by default those of the input. A source
    whose texts are all empty has rate 1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = documents.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.octet_length(text)).alias("size"), F.count(F.lit(1)).alias("documents"))
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(alpha)))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    sizes = written(sizes.withColumn("raw", raw), "sources")
    sums = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("raw"), F.lit(0.0)).alias("raw")).first()
    share = F.col("raw") / F.lit(float(sums["raw"])) if sums["raw"] > 0 else F.lit(0.0)
    mix = float(sums["size"] if total is None else total)
    return sizes.select("source", "size", "documents", share.alias("weight"), F.when(F.col("size") > 0, share * mix / F.col("size")).otherwise(1.0).alias("rate")), mix


def mix(documents: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float | None = None, seed: int = 0, shuffle: bool = True, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = None, order_col: str | None = None, parts: int | None = None) -> DataFrame:
    """The documents with all their columns, each as often as its Poisson draw says, in a global pseudo-random order.

    parts: partitions of the result, by default what spark.sql.shuffle.partitions says, and one for each core at least: ranges of the
    order, sorted within (and spilled where they exceed memory). It doesn't grow by itself with the input, since every part costs
    each task of the shuffle a block. copy_col, order_col: names of two more columns, the copy's number from 1 and the hash that orders the result. Copies of a
    document lie apart, since the order hashes the copy's number too. A null source is a source of its own; null texts count as
    empty; a null id counts as the text 'null'; repeated rows (same id and text) draw the same number of copies; an empty table
    gives no rows. Sources with weight 0 have no copies, which is what that weight means.
    """
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in ("source", "digest", "copies", "cdf", "draws", "copy", "order")}
    rate, _ = rates(documents, weights, alpha, total, source_col, text_col)
    draws = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / LARGEST_MEAN).cast("double"))
    table = rate.select(F.col("source").alias(own["source"]), draws.cast("int").alias(own["draws"]), poisson_cdf(F.col("rate") / draws).alias(own["cdf"]))
    joined = documents.join(table, F.col(source_col).eqNullSafe(F.col(own["source"])))
    joined = joined.withColumn(own["digest"], F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    digest, cdf = F.col(own["digest"]), F.col(own["cdf"])

    def drawn(label: Column) -> Column:
        """A Poisson number from the uniform number that the id, the text and a label give."""
        u = hash_unit(F.col(id_col), digest, label)
        return F.size(F.filter(cdf, lambda c: c <= u)).cast("long")

    first = drawn(F.lit(f"copies{seed}"))
    several = F.aggregate(F.sequence(F.lit(1), F.col(own["draws"]) - 1), first, lambda n, j: n + drawn(F.concat(F.lit(f"copies{seed}:"), j.cast("string"))))
    counted = joined.withColumn(own["copies"], F.when(F.col(own["draws"]) > 1, several).otherwise(first)).where(F.col(own["copies"]) > 0)
    copies = counted.withColumn(own["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(own["copies"]))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), digest, F.col(own["copy"]).cast("string"), F.lit(f"order{seed}"))), 1, ORDER_BITS // 4), 16, 10).cast("long")
    out = copies.withColumn(own["order"], order).drop(own["cdf"], own["digest"])
    if shuffle:
        # the hash is uniform, so ranges of equal width need no sample of the rows
        spark = documents.sparkSession
        parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        out = out.repartitionById(parts, F.floor(F.col(own["order"]) / F.lit(2.0**ORDER_BITS / parts)).cast("int")).sortWithinPartitions(own["order"])
    extra = [F.col(own[c]).alias(name) for c, name in (("copy", copy_col), ("order", order_col)) if name]
    return out.select(*(F.col(f"`{c}`") for c in documents.columns), *extra)
