import random
import zlib

import numpy as np

from stemforge.llm import labelled, quality, toxicity

DATA = "/root/testdata/sf0.1"


def held_out_accuracy(spark, module, label, threshold):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    rows = module.score(docs.join(labels, "doc_id"), model, threshold).join(labels, "doc_id").where("held_out").collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), np.mean([r["predicted"] for r in rows if r[label] == 1])


def test_toxicity_on_held_out_rows(spark):
    accuracy, recall = held_out_accuracy(spark, toxicity, "toxic", 0.5)
    assert accuracy > 0.97 and recall > 0.85


def test_quality_on_held_out_rows(spark):
    accuracy, recall = held_out_accuracy(spark, quality, "quality", 0.3)
    assert accuracy > 0.97 and recall > 0.97


def test_pairs_are_learned_beyond_single_terms():
    r = random.Random(3)
    noise = [f"n{i}" for i in range(60)]
    texts, y = [], []
    for i in range(1500):
        insult, group = i % 2 == 0, i % 4 < 2
        words = r.sample(noise, 8) + ["fool"] * insult + ["people"] * group
        texts.append(" ".join(words))
        y.append(int(insult and group))
    m = toxicity.train(texts, y, 0.25)
    a, b = (toxicity.xxhash.xxh64_intdigest(w, 1) & ((1 << toxicity.BITS) - 1) for w in ("fool", "people"))
    assert float(m.v[m.rows(np.array([a]))[0]] @ m.v[m.rows(np.array([b]))[0]]) > 0.05
    terms = toxicity.Terms()
    margin = lambda t: m.margin(toxicity.term_ids(t, terms))
    assert margin("fool people n1") > 0 > max(margin("fool n1"), margin("people n1"), margin("n1 n2"))


def test_pairs_of_words_that_mean_nothing_alone_are_learned():
    r = random.Random(4)
    noise = [f"n{i}" for i in range(80)]
    texts, y = [], []
    for i in range(2000):
        words, one, two = r.sample(noise, 8), i % 2 == 0, i % 4 < 2
        words[r.randrange(6) : 0] = ["left"] * one + ["right"] * two
        texts.append(" ".join(words))
        y.append(int(one != two))
    m = toxicity.train(texts, y, 0.5)
    terms = toxicity.Terms()
    margin = lambda t: m.margin(toxicity.term_ids(t, terms))
    assert min(margin("left n1 n2"), margin("right n1 n2")) > 0 > max(margin("left right n1 n2"), margin("n1 n2"))


def test_an_insult_of_few_texts_is_learned():
    r = random.Random(5)
    noise = [f"n{i}" for i in range(400)]
    text = lambda i: " ".join(r.sample(noise, 20) + (["zounderkite"] if i < 8 else ["scum"] if i < 3000 else []))
    m = toxicity.train([text(i) for i in range(6000)], [int(i < 3000) for i in range(6000)], 0.3)
    terms = toxicity.Terms()
    plain = m.margin(toxicity.term_ids("n1 n2", terms))
    assert m.margin(toxicity.term_ids("n1 n2 zounderkite", terms)) > plain + 0.3


def test_the_pairwise_sum_is_that_over_all_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.5, np.array([3, 5, 70, 900, 12345]), rng.normal(size=5), rng.normal(size=(5, toxicity.FACTORS)))
    at = [0, 2, 3, 4]
    want = 0.5 + m.w[at].sum() + sum(m.v[i] @ m.v[j] for k, i in enumerate(at) for j in at[:k])
    assert abs(m.margin(np.array([3, 4, 70, 900, 12345, 99999])) - want) < 1e-9


def test_whole_texts_count():
    m = toxicity.train(["idiot scum " + "a b c"] * 30 + ["nice day a b c"] * 30, [1] * 30 + [0] * 30, 0.5)
    long = "the " * 50000
    t = toxicity.Terms()
    assert m.margin(toxicity.term_ids(long + "idiot scum", t)) > m.margin(toxicity.term_ids(long, t))
    q = quality.Model(np.arange(1 << quality.BITS, dtype="f4") / (1 << quality.BITS), 0.0)
    words = [f"w{i % 977}" for i in range(50001)]
    rows = quality.features(words)
    parts = quality.odds(q, " ".join(words))
    assert abs(parts - q.margin[rows].mean(dtype=np.float64)) < 1e-3


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "x", "s"), (2, "x y", "s"), (2, "x y", "s")], "doc_id long, text string, score string")
    for module in (toxicity, quality):
        for labels in ([], [(1, 1, 1), (None, 0, 0), (3, 0, 0)], [(i, i % 2, i % 2) for i in range(40)] + [(1, None, None)]):
            model = module.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
            got = module.score(docs, model).collect()
            assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
            assert module.score(docs.limit(0), model).count() == 0
            assert docs.where(module.scored_like(docs, model) >= 0).count() == 4


def test_the_sample_leaves_out_held_out_rows_and_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    rows, prior = labelled.training_rows(docs.union(docs), labels, "quality", 50)
    got = rows.collect()
    assert len(got) == 100 and sum(r["label"] for r in got) == 50 and 0.4 < prior < 0.6
    assert all(zlib.crc32(r["text"][1:].encode()) % 5 for r in got)
