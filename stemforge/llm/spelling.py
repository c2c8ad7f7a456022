"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under the most frequent form.

Symmetric-delete join: every word emits itself and its distinct single deletions. Two words at distance one share exactly one of these
keys: the shorter one if one has a character more, else what is left of both without the character that differs. Keys are 64-bit
hashes in place of strings, computed for all deletions of a word from sums over its prefixes, so a word of n characters emits n + 1 rows
of a few bytes, not n strings of n characters. Words that share a key are at distance two at most, which bounds a key's words by the
alphabet; every candidate is verified by its exact distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.shared import groups_of, texts_of, written

# What a word is made of, and the letters that are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Distinct words that a task counts before it hands their counts on.
COUNTED_WORDS = 200_000
#: Characters of a text above which its runs aren't held as a list.
LONG_TEXT = 1 << 20
#: An odd number to whose powers characters are multiplied in a key, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(doc_id: object, text: str, every: int) -> Counter:
    """The lower-cased runs of a text by count. A run whose crc32 with the document's id is a multiple of every loses one character."""
    runs = Counter(RUN.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in RUN.finditer(text)))
    found: Counter = Counter()
    prefix = f"{'null' if doc_id is None else doc_id}:"
    for run, n in runs.items():
        word = run.lower() if run.isascii() else run.translate(LOWER)
        h = zlib.crc32((prefix + word).encode())
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        found[word] += n
    return found


def damaged_words(documents: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of every word of all texts with least_length characters and least_count occurrences, after one character is deleted
    from every run of letters whose crc32 of '<id>:<run>' is a multiple of every.

    A null text has no words, a null id counts as the text 'null', repeated rows count each; an empty table has no words; no text is cut.
    Counts are summed within tasks before they are shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in groups_of(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                for word, n in words_of(doc_id, text, every).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > COUNTED_WORDS:
                    yield handed_on()
        yield handed_on()

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(word: str) -> np.ndarray:
    """Hashes of a word and of its distinct single deletions, the word's own first.

    A string's hash is the sum of its characters times the powers of BASE at their places. Without the character at i it is the sum
    before i, and the sum behind i moved on by one place.
    """
    chars = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    powers = np.full(len(chars), BASE, np.uint64)
    powers[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * np.cumprod(powers))])
    shorter = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
    return np.concatenate([sums[-1:], np.unique(shorter)])


def keyed(words: DataFrame) -> DataFrame:
    """key, id and size (characters) of every word (id, word) and of each of its distinct single deletions."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", words.schema["id"].dataType), T.StructField("size", T.LongType()), T.StructField("whole", T.BooleanType())])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in groups_of(batches, "word", 1 << 16):
                texts = texts_of(batch, "word")
                keys = [deletion_keys(w) for w in texts]
                counts = np.array([len(k) for k in keys], np.int64)
                rows = np.repeat(np.arange(len(keys)), counts)
                whole = np.zeros(len(rows), bool)
                whole[np.cumsum(counts) - counts] = True
                sizes = np.array([len(w) for w in texts], np.int64)[rows]
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("id").take(pa.array(rows)), pa.array(sizes), pa.array(whole)], schema.names)

    return words.select("id", "word").mapInArrow(emit, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b, each (id, word, n), of all pairs of words (id, word, n) that differ by exactly one inserted, deleted or replaced code
    point; a pair comes once."""
    keys = written(keyed(words), "deletions")
    side = lambda x: keys.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "size", "whole")))
    # a key that both own is a whole word of one and a deletion of the other, or a deletion of both, of one length then
    longer = F.col("a_whole") & ~F.col("b_whole") & (F.col("b_size") == F.col("a_size") + 1)
    equal = ~F.col("a_whole") & ~F.col("b_whole") & (F.col("a_size") == F.col("b_size")) & (F.col("a_id") < F.col("b_id"))
    pairs = side("a").join(side("b"), "key").where(longer | equal).select("a_id", "b_id")
    text = lambda x: words.select(F.col("id").alias(f"{x}_id"), F.struct("word", "n").alias(x))
    both = pairs.join(text("a"), "a_id").join(text("b"), "b_id").select("a", "b")
    # a pair shares one key by its true distance; hashes that are equal by chance could give it another
    return both.where(F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1).distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the end of the chain of forms, the word itself if it has none. Chains are halved in every round;
    a form is more frequent than its word, so there are no circles."""
    links = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(counted: DataFrame, dominance: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of counted (word, n; words distinct).

    n_near: words at distance one. form: among these the one of largest n (ties: smallest in code-point order), if its n is at least
    dominance * n, else null (form_n likewise). root: the word that forms lead to in the end. Words of any length take part whole; an
    empty table gives no rows.
    """
    words = written(counted.select(F.unhex(F.md5(F.col("word").cast("binary"))).alias("id"), "word", "n"), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    # the least of (-n, word) is the most frequent word; UTF-8 keeps the order of code points
    best = both.groupBy(F.col("a.word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b.n")).alias("minus"), F.col("b.word").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), (-F.col("best.minus")).alias("form_n"), "best.form")
    enough = F.col("form_n") >= dominance * F.col("n")
    forms = written(found.select("word", "n", "n_near", *(F.when(enough, F.col(c)).alias(c) for c in ("form", "form_n"))), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
