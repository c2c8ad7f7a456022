"""The classifiers' and the token counter's queries over a whole table, against plain loops: features by hand and sums in order, over
the learned weights; counts by the tokenizer's own library."""

import math
import re
import zlib

import sentencepiece
import xxhash

from stemforge.llm import quality, toxicity
from stemforge.llm.queries import QUERIES, TOKEN_LIMIT, tokenizer_file

DATA = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def agrees(rows, scores, threshold):
    assert len(rows) == len(scores) > 100
    for r in rows:
        want = scores[r["doc_id"]]
        assert abs(r["score"] - want) < 1e-6 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(want >= threshold) or abs(want - threshold) < 1e-6


def toxic_score(text, bias, single, factors):
    terms = set()
    for word in set(re.findall(r"\w+", text.lower())):
        terms.add(xxhash.xxh64_intdigest(word, 1) % 2**toxicity.BITS)
        terms |= {xxhash.xxh64_intdigest(word[:n], 1 + n) % 2**toxicity.BITS for n in toxicity.BEGINNINGS if len(word) > n}
    known = sorted(t for t in terms if t in single)
    total = bias + sum(single[t] for t in known)
    for i, a in enumerate(known):
        for b in known[:i]:
            total += sum(x * y for x, y in zip(factors[a], factors[b]))
    return sigmoid(total)


def test_toxicity_query(spark):
    docs, labels, texts = tables(spark)
    m = toxicity.fit(docs, labels)
    single = dict(zip(m.ids.tolist(), m.w.tolist()))
    factors = dict(zip(m.ids.tolist(), m.v.tolist()))
    assert single
    agrees(QUERIES["op5_toxicity"](spark, DATA).collect(), {i: toxic_score(t, m.bias, single, factors) for i, t in texts.items()}, 0.5)


def quality_score(text, margin, bias):
    words = re.findall(r"\S+", text)
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    rows = [h % 2**quality.BITS for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        rows.append(quality.REPEATED if a == b else ((a * 0x9E3779B97F4A7C15 & MASK) ^ b) * 0xC2B2AE3D27D4EB4F % 2**64 >> 64 - quality.BITS)
    for word in words:
        marked = f" {word} "
        for n in quality.N_GRAMS:
            for k in range(len(marked) - n + 1):
                h = 0
                for c in marked[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) & MASK
                rows.append((h * 0x9E3779B97F4A7C15 + n) * 0xC2B2AE3D27D4EB4F % 2**64 >> 64 - quality.BITS)
    return sigmoid(bias + sum(margin[r] for r in rows) / len(rows) if rows else bias)


def test_quality_query(spark):
    docs, labels, texts = tables(spark)
    m = quality.fit(docs, labels)
    margin = m.margin.tolist()
    agrees(QUERIES["op9_quality"](spark, DATA).collect(), {i: quality_score(t, margin, m.bias) for i, t in texts.items()}, 0.3)


def test_token_count_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    _, _, texts = tables(spark)
    rows = QUERIES["op4_token_counts"](spark, DATA).collect()
    assert len(rows) == len(texts) > 100
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > TOKEN_LIMIT)
        within = r["within_budget"]
        assert within == len(text) if n <= TOKEN_LIMIT else len(library.encode(text[:within])) <= TOKEN_LIMIT < len(library.encode(text[: within + 1]))


def test_features_are_counted_without_a_cap():
    texts = ["ab " * 40_000, "cd ef " * 20] * 5
    m = quality.train(texts, [1, 0] * 5, 0.5)
    assert quality.odds(m, texts[0]) > 0 > quality.odds(m, texts[1])
