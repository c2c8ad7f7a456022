import random
import zlib

import numpy as np
import pytest

from stemforge.llm import packing as P
from stemforge.llm import token_counts as C
from stemforge.llm.queries import TOKEN_LIMIT, tokenizer_file

ODD = ["", " ", "  a  b ", "\n\n", "a\tb\r\nc", "<s> </s> <unk> <0x41>", "日本語のテキスト。混ぜmixed", "🙂🙃 é è", "A" * 3000, "x" * 100 + " " * 50 + "y", "naïve façade — “quotes” …", "１２３ ａｂｃ", "<|endoftext|> <|startoftext|>hello", "\x1c\x1d words\x1e here\x1f", "foo</w>bar"]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def texts(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return ODD + docs[:120]


def test_counts_are_the_librarys(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (0, texts[0], "x")]
    got = C.token_index(spark.createDataFrame(rows, SCHEMA), tokenizer_file("piece_bpe_32k.model"), 50).collect()
    assert len(got) == len(rows)
    for (doc_id, text, _), r in zip(rows, got):
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"]) == (doc_id, len((text or "").encode()), len(lib.encode(text or "")))


def test_every_prefix(texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    c = C.counter(tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(1)
    for t in ODD + [t[a : a + 60] for t in texts if len(t) > 100 for a in [r.randrange(len(t) - 60)]]:
        t = t[:200]
        assert c.prefixes(t).tolist() == [len(lib.encode(t[:i])) for i in range(len(t) + 1)], t
        assert C.open_index(C.pack_index(c.prefixes(t))).tolist() == c.prefixes(t).tolist()


def check_packing(rows, texts, window):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(sequences)


def test_packing_holds_every_id_once(spark, texts):
    texts = [*texts, None, "word " * 20000]
    rows = P.pack(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).coalesce(1), tokenizer_file("word_bpe_49k.json"), TOKEN_LIMIT).collect()
    padding, n = check_packing(rows, texts, TOKEN_LIMIT)
    assert padding < TOKEN_LIMIT + 20 * n


def test_packing_of_odd_tables(spark):
    rows = P.pack(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "x")], SCHEMA).coalesce(1), tokenizer_file("word_bpe_49k.json"), 4).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows if r["start"] == 0) == [(0, 1), (1, 3), (1, 3)]
    assert P.pack(spark.createDataFrame([], SCHEMA), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_the_plan_costs_least():
    r = random.Random(5)
    for _ in range(60):
        pos = np.array(sorted({0, *r.sample(range(1, 60), 14), 60}))
        window = max(int(np.diff(pos).max()), r.randint(8, 24))
        penalty = np.array([0, *(r.choice([0, 2, 5]) for _ in pos[1:-1]), 0])
        free = (4,)

        def cost(cuts):
            total, last = 0, 0
            for i in cuts:
                n = int(pos[i] - pos[last])
                if n > window:
                    return None
                total += (0 if n in free else window - n) + int(penalty[i])
                last = i
            return total

        best = [0] + [None] * (len(pos) - 1)
        for i in range(1, len(pos)):
            best[i] = min((best[j] + (0 if int(pos[i] - pos[j]) in free else window - int(pos[i] - pos[j])) + int(penalty[i]) for j in range(i) if best[j] is not None and pos[i] - pos[j] <= window), default=None)
        assert cost(P.plan(pos, penalty, window, free)) == best[-1]


def test_words_are_looked_up_in_the_model_once(monkeypatch):
    """op10: a task's tables hold the words of some 10,000 documents, so that few are made twice."""
    words = P.WordIds(tokenizer_file("word_bpe_49k.json"))
    made, by_model = [], P.WordIds.by_model
    monkeypatch.setattr(P.WordIds, "by_model", lambda self, w: (made.append(w), by_model(self, w))[1])
    letters = "abcdefghijklmnop"
    many = ["".join(letters[(i >> s) & 15] for s in (16, 12, 8, 4, 0)) for i in range(250_000)]
    for _ in range(2):
        for i in range(0, len(many), 1000):
            words.ids(" ".join(many[i : i + 1000]))
    assert len(made) == len(many)
