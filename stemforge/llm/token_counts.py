"""Token counts of every prefix of a text, by dynamic programming over a BPE piece vocabulary.

A prefix of a text has exactly one last token t such that the prefix without t is encoded validly and the pair (its last
token, t) stays as it is when the two are encoded alone. So count[i] = count[i - len(t)] + 1, and one pass gives the exact
count at every position. No piece of the vocabulary crosses into a run of blanks or over a line feed, so the pass runs over
words, and the arrays of words met before are kept in the task.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm.shared import groups_of, texts_of

BLANK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
#: Words that can be counted on their own where no piece crosses from a Latin letter to another sign, and where some do.
FINE = re.compile(f"{BLANK}*[{LATIN}]+|[^{LATIN}{BLANK}\n]+|{BLANK}+[^{LATIN}{BLANK}\n]*|\n")
COARSE = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
#: Characters of words kept in each of a task's two tables, with 8 more for each word.
KEPT_CHARACTERS = 5_000_000
WIDE = b""


class PrefixCounter:
    """Exact counts at every prefix, as the library gives them for a BPE model with byte fallback and no normalisation."""

    def __init__(self, model_path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece crosses a word: this model can't be counted word by word")
        crosses = re.compile(f"[{LATIN}][^{LATIN}{BLANK}]|[^{LATIN}{BLANK}][{LATIN}]")
        self.chunk = COARSE if any(map(crosses.search, self.score)) else FINE
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored pair is joined first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max(((score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def stays(self, left: str | None, right: str) -> bool:
        """Whether right after left (or right alone) is encoded as just these."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merged((left or "") + right) == ([left, right] if left else [right])
        return known

    def counts(self, word: str) -> list[int]:
        """counts[i]: tokens of word[:i]."""
        score, longest, pairs, stays = self.score, self.longest, self.pairs, self.stays
        last: list[str | None] = [None]
        out = [0]
        for i in range(1, len(word) + 1):
            for start in range(i - longest if i > longest else 0, i):
                piece = word[start:i]
                if piece in score or start == i - 1:
                    if (fits := pairs.get((last[start], piece))) is None:
                        fits = stays(last[start], piece)
                    if fits:
                        last.append(piece)
                        # a character without a piece is spelt as the bytes of its UTF-8
                        out.append(out[start] + (1 if piece in score else len(piece.encode())))
                        break
            else:
                raise AssertionError(f"no last token for {word[:i]!r}")
        return out

    def learn(self, words: list[str]) -> None:
        """Keep, for each word, the steps of its counts from prefix to prefix as signed bytes (WIDE if one doesn't fit)."""
        if self.kept > KEPT_CHARACTERS:
            self.words, self.older, self.kept = {}, self.words, 0
        for w in words:
            if w not in self.words:
                self.kept += len(w) + 8
                if (found := self.older.get(w)) is None:
                    c = self.counts(w)
                    steps = [b - a for a, b in zip(c, c[1:])]
                    found = array("b", steps).tobytes() if -128 <= min(steps) <= max(steps) <= 127 else WIDE
                self.words[w] = found

    def prefixes(self, text: str) -> np.ndarray:
        """out[i]: tokens of text[:i], for i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int32)
        words = self.chunk.findall(BLANK + text.replace(" ", BLANK))
        try:
            steps = b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self.learn(words)
            steps = b"".join(map(self.words.__getitem__, words))
        if len(steps) == len(text) + 1:
            out = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32)
        else:  # WIDE has another length than any word that it stands for
            out = np.cumsum(np.concatenate([np.diff(self.counts(w)) if self.words[w] is WIDE else np.frombuffer(self.words[w], np.int8) for w in words]), dtype=np.int32)
        out[0] = 0  # the blank put before a text isn't a prefix of it
        return out


@functools.lru_cache(2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


#: Steps that two bits of an index stand for; the fourth value stands for any other, told in full behind.
STEPS = np.array([0, 1, -1], np.int64)


def pack_index(counts: np.ndarray) -> bytes:
    """The steps of a text's counts in two bits each, and those that are none of STEPS as numbers, compressed."""
    steps = np.diff(counts).astype(np.int64)
    codes = np.select([steps == x for x in STEPS], range(len(STEPS)), len(STEPS)).astype(np.uint8)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    quads = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    head = np.array([len(steps)], "<i8").tobytes()
    return zlib.compress(head + np.bitwise_or.reduce(quads, axis=1).tobytes() + steps[codes == len(STEPS)].astype("<i4").tobytes(), 6)


def open_index(index: bytes) -> np.ndarray:
    data = zlib.decompress(index)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    quads = np.frombuffer(data, np.uint8, -(-n // 4), 8)
    codes = ((quads[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n]
    steps = np.append(STEPS, 0)[codes]
    steps[codes == len(STEPS)] = np.frombuffer(data, "<i4", -1, 8 + len(quads))
    return np.concatenate([[0], np.cumsum(steps)])


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most budget tokens (a longer prefix can have fewer tokens)."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def token_index(documents: DataFrame, model_path: str, budget: int = 4096, keep_index: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, within_budget (characters of the longest prefix of at most budget
    tokens) and, if keep_index, prefix_index: the exact token count at every prefix, packed.

    A null text counts as empty (0 tokens, 0 characters); null ids and repeated rows stay, one row each; an empty table gives
    no rows; other columns of the input, whatever their names, are not read. No text is cut.
    """
    fields = [T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("within_budget", T.LongType())]
    schema = T.StructType(fields + [T.StructField("prefix_index", T.BinaryType())] * keep_index)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in groups_of(batches):
            rows = []
            for text in texts_of(batch):
                at = c.prefixes(text)
                n = int(at[-1])
                rows.append((len(text.encode()), n, len(text) if n <= budget else longest_within(at, budget), pack_index(at) if keep_index else b""))
            columns = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: len(schema.names)], schema.names)

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)


@F.pandas_udf(T.LongType())
def prefix_tokens(index, n_chars):
    """Tokens of a document's first n_chars characters, from its prefix index (null index: null)."""
    import pandas as pd

    return pd.Series([None if i is None or n is None else int((a := open_index(i))[min(max(int(n), 0), len(a) - 1)]) for i, n in zip(index, n_chars)], dtype="Int64")


@F.pandas_udf(T.LongType())
def prefix_within(index, budget):
    """Characters of the longest prefix of at most budget tokens, from a document's prefix index (null index: null)."""
    import pandas as pd

    return pd.Series([None if i is None or b is None else longest_within(open_index(i), int(b)) for i, b in zip(index, budget)], dtype="Int64")


