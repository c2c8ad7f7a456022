"""Audit of how text filters interact: what each filter of a chain removes, for every order of the chain.

A document gives a mask with one bit for each filter that it fails. Masks are counted by part of the corpus (a source): a part has at
most 2 ** (number of filters) cells, however large it is, and all that follows works on cells. A cell is unpivoted against the steps
of every order: one row for each cell, order and step. A running bitwise or over the steps before tells whether an earlier
filter had removed the cell's documents; conditional sums over cells give the counts of a step, and a window over a filter's rows in all
orders its total (its Shapley value times the number of orders).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.llm.shared import written

#: The filters of the audit; the last one needs the whole table.
FILTERS = "ABCDE"
REPEATED = "E"
# White space between words, and the limits of the filters.
WHITE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def checked(documents: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask of the filters that look at a text alone, which it fails; a null text counts as
    empty and a null part as the empty string.

    A: under 50 words (what lies between white space); B: under 65 distinct words of 100; C: over 5 letters A to Z of 100 code points;
    D: any of # $ % & * |.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    n, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(f, bit(x)).otherwise(0) for x, f in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, mask, ...) whose mask also says that a row of a smaller id has the same digest. A null id is neither smaller
    than another nor has one that is. Copies meet only in a count, never in a join: rows are joined with the firsts by id too."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    both = rows.join(firsts, ["doc_id", "digest"], "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return both.withColumn("mask", F.col("mask") + F.when(repeated, bit(REPEATED)).otherwise(0)).drop("first")


def cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good and toxic: rows, and rows whose id is labelled quality 1 and toxic 1 (by any of its labels)."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = rows.join(known, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def steps(filters: str = FILTERS) -> Column:
    """An array of (filter_order, step, letter, bit) with every step of every order of the filters."""
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(filters)))

    def of(order: Column) -> Column:
        def step(i: Column) -> Column:
            letter = F.substring(order, i, F.lit(1))
            return F.struct(order.alias("filter_order"), i.alias("step"), letter.alias("letter"), F.pow(F.lit(2), F.instr(F.lit(filters), letter) - 1).cast("int").alias("bit"))

        return F.transform(F.sequence(F.lit(1), F.lit(len(filters))), step)

    return F.flatten(F.transform(orders, of))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, filter_order and step of cells (part, mask, n, good, toxic), zeros included: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley."""
    long = counted.select("*", F.explode(steps(filters)).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("failed", failed != 0).withColumn("gone", F.coalesce(F.bit_or(failed).over(before), F.lit(0)) != 0)
    here = F.col("failed") & ~F.col("gone")

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    counts = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("failed") & ~F.col("gone")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("failed") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for every part of documents, every
    order of the filters A to E and every step of it.

    Null texts count as empty, which fail A alone and are each other's copies; null parts as the empty string; rows with a null id count,
    fail no E and have no labels; repeated rows (same id and text) count each, and neither is the other's copy. Labels of an id count
    if any of its rows has them. An empty table gives no rows; other columns of the input, whatever their names, are not read.
    """
    rows = written(checked(documents, id_col, part_col, text_col), "masks")
    return interactions(cells(with_repeats(rows), labels))
