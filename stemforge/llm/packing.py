"""Order-preserving packing of token streams into windows, by dynamic programming with a monotone queue.

The documents of a partition form one stream of tokens in their order. Windows may be cut where a document ends (free), where
a sentence ends (a small penalty) and, in stretches without a sentence end, at evenly spaced places (a larger one). The least
sum of padding and penalties is f[i] = penalty[i] + min over cuts j within one window of f[j] + padding(pos[i] - pos[j]).
As padding is window - (pos[i] - pos[j]), the minimum is that of f[j] + pos[j] over a sliding range: a monotone queue gives it
in constant time. A window filled to a large power of two needs no padding, which adds a few transitions of fixed length.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.shared import groups_of, texts_of

SENTENCE_END = re.compile("[.!?。！？…]")
#: What str.split takes for white space and the tokenizer's own rule for white space doesn't.
NOT_WHITE = re.compile("[\x1c-\x1f]")
#: A word of Latin-1 letters, or such a word before signs: the tokenizer cuts where the letters end.
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
#: The byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on.
PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: chr(b) if b in PRINTING else chr(256 + i) for i, b in enumerate([b for b in range(256) if b not in PRINTING] + PRINTING)}
PROBES = ["The", "élan", "ÀÉß", "zzyzx", "internationalisation", "ÿ"]
#: Tokens of padding that a cut inside a document is worth: after a sentence, or within one.
AFTER_SENTENCE, WITHIN_SENTENCE = 6, 12
#: Tokens without a sentence end after which a cut within the sentence is allowed.
LONGEST_STRETCH = 128
#: Windows that are planned together.
PLANNED = 128
#: Characters of words kept in each of a task's two tables, with 8 more for each word.
KEPT_CHARACTERS = 6_000_000


class WordIds:
    """Token ids of a text, looked up word by word: the tokenizer never joins tokens over white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # by the model alone a plain word costs a fifth of what the whole library takes
        self.direct = all(self.by_model(w) == np.array(self.lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes() and self.lib.encode(w + "?!'", add_special_tokens=False).ids == self.lib.encode(w, add_special_tokens=False).ids + self.lib.encode("?!'", add_special_tokens=False).ids for w in PROBES)
        self.ends = np.array([bool(SENTENCE_END.search(self.lib.id_to_token(i) or "")) for i in range(self.lib.get_vocab_size())])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = 0

    def by_model(self, word: str) -> bytes:
        spelt = word.lower()
        tokens = self.lib.model.tokenize(spelt if spelt.isascii() else spelt.encode().decode("latin-1").translate(BYTE_LEVEL))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def known(self, word: str) -> bytes | None:
        """A word's ids if a table has them, kept in the newer one."""
        if (found := self.words.get(word)) is None and (found := self.older.get(word)) is not None:
            self.keep(word, found)
        return found

    def keep(self, word: str, ids: bytes) -> None:
        self.words[word] = ids
        self.kept += len(word) + 8

    def learn(self, words: list[str]) -> None:
        if self.kept > KEPT_CHARACTERS:
            self.words, self.older, self.kept = {}, self.words, 0
        split, rest, older, plain = [], [], self.older.get, PLAIN_WORD.fullmatch
        for w in set(words).difference(self.words):
            if (found := older(w)) is not None:
                self.keep(w, found)
                continue
            m = plain(w) if self.direct else None
            if m is None:
                rest.append(w)
            elif not m[2]:
                self.keep(w, self.by_model(w))
            else:
                if self.known(m[1]) is None:
                    self.keep(m[1], self.by_model(m[1]))
                if self.known(m[2]) is None:
                    rest.append(m[2])
                split.append((w, m[1], m[2]))
        rest = list(dict.fromkeys(rest))
        for w, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False)):
            self.keep(w, struct.pack(f"<{len(e.ids)}I", *e.ids))
        for w, head, tail in split:
            self.keep(w, self.words[head] + self.words[tail])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if NOT_WHITE.search(text):
            return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        words = text.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.words.__getitem__, words))

    def sentence_ends(self, ids: bytes) -> np.ndarray:
        """After how many of the ids a sentence ends."""
        return np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def plan(pos: np.ndarray, penalty: np.ndarray, window: int, free: tuple[int, ...]) -> list[int]:
    """Indices of the cuts that cost least, the last included; pos[0] = 0, and neighbours are at most a window apart.

    free: window lengths that need no padding besides the full one.
    """
    n = len(pos)
    exact: dict[int, list[int]] = {}
    for length in free:
        at = np.searchsorted(pos, pos - length)
        hit = np.flatnonzero((at < n) & (pos >= length) & (pos[np.minimum(at, n - 1)] == pos - length))
        for i, j in zip(hit.tolist(), at[hit].tolist()):
            exact.setdefault(i, []).append(j)
    p, pen = pos.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), rising
    for i in range(1, n):
        here = p[i]
        least = here - window
        while p[queue[0][1]] < least:
            queue.popleft()
        best, j = queue[0]
        best += window - here
        if i in exact:
            for k in exact[i]:
                if cost[k] < best:
                    best, j = cost[k], k
        best += pen[i]
        cost[i], back[i] = best, j
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    out, i = [], n - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


class Stream:
    """The tokens of documents in their order, not yet packed."""

    def __init__(self, window: int):
        self.window, self.free = window, tuple(2**k for k in range(max(0, window.bit_length() - 4), window.bit_length()) if 2**k < window)
        self.docs: list[list] = []  # id, ids as bytes, places of sentence ends, first token not yet packed
        self.held = 0
        self.made = 0

    def add(self, doc_id, ids: bytes, ends: np.ndarray) -> None:
        self.docs.append([doc_id, ids, ends, 0])
        self.held += len(ids) // 4

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window may end, and the penalty of each."""
        at, costs, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, ends, first in self.docs:
            n = len(ids) // 4 - first
            inner = ends[(ends > first) & (ends < first + n)] - first
            marks = np.concatenate([[0], inner, [n]])
            gaps = np.flatnonzero(np.diff(marks) > LONGEST_STRETCH)
            extra = [np.arange(marks[g] + LONGEST_STRETCH, marks[g + 1], LONGEST_STRETCH) for g in gaps]
            kinds = [(inner, AFTER_SENTENCE), *((e, WITHIN_SENTENCE) for e in extra), (np.array([n]), 0)]
            places, cost = np.concatenate([k for k, _ in kinds]), np.concatenate([np.full(len(k), c) for k, c in kinds])
            order = np.argsort(places, kind="stable")
            at.append(places[order] + base)
            costs.append(cost[order])
            base += n
        pos, first = np.unique(np.concatenate(at), return_index=True)
        return pos, np.concatenate(costs)[first]

    def packed(self, last: bool) -> Iterator[tuple]:
        """Pieces (doc_id, start, length, crc, doc_tokens, sequence, offset); unless last, the end of the stream stays."""
        if not self.docs:
            return
        pos, penalty = self.cuts()
        ends = [int(pos[i]) for i in plan(pos, penalty, self.window, self.free)]
        if not last:
            ends = ends[: max(1, len(ends) - 4)]
        begin, k = 0, 0
        for end in ends:
            offset = 0
            while begin < end:
                doc = self.docs[k]
                start, n = doc[3], len(doc[1]) // 4
                length = min(n - start, end - begin)
                yield doc[0], start, length, zlib.crc32(doc[1][4 * start : 4 * (start + length)]), n, self.made, offset
                doc[3] += length
                offset += length
                begin += length
                k += doc[3] == n
            self.made += 1
        self.docs = self.docs[k:]
        self.held -= begin


def pack(documents: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then end_id; every id lies in exactly one piece, pieces keep the order of the input
    within its partitions, and a sequence holds at most window ids. A null or empty text is the end id alone; null ids and
    repeated rows are packed row by row; an empty table gives no rows; other columns are not read. No text is cut off: long
    ones run over as many sequences as they need.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stream, first = word_ids(tokenizer_path), Stream(window), TaskContext.get().partitionId() << 33
        id_type = pa.null()

        def table(last: bool) -> pa.RecordBatch | None:
            rows = list(stream.packed(last))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *(pa.array([r[i] + first * (i == 5) for r in rows], pa.int64()) for i in range(1, 7))], schema.names) if rows else None

        for batch in groups_of(batches):
            id_type = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = words.ids(text)
                stream.add(doc_id, ids + int(end_id).to_bytes(4, "little"), words.sentence_ends(ids))
                if stream.held >= PLANNED * window:
                    yield table(False)
        if (rest := table(True)) is not None:
            yield rest

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
