"""The first pairs and the count of all, without making all, against brute force over all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from stemforge.operators import report
from stemforge.operators import similarity as S
from stemforge.sources.tables import Workspace
from tests.test_retrieval import strings

SCHEMA = "id long, stem_norm string, options array<string>, answer string"


def brute(texts, least):
    out = []
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j]
            if a and b and min(len(a), len(b)) / max(len(a), len(b)) >= 0.6 and (ratio := difflib.SequenceMatcher(None, a, b).ratio()) >= least:
                out.append((-ratio, i, j))
    return sorted(out)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, ["x"], "A") for i, t in enumerate(texts)], SCHEMA)


def top(spark, texts, least, k, space=None):
    return [(-r["ratio"], r["a_id"], r["b_id"]) for r in report.top_duplicates(rows(spark, texts), least, k, space).collect()]


@pytest.mark.parametrize("k", [3, 25, 100_000])
def test_first_pairs_and_count(spark, k):
    r = random.Random(k)
    texts = r.choices(strings(40, 4), k=70) + ["", ""]
    want = brute(texts, 0.75)
    assert top(spark, texts, 0.75, k) == want[:k]
    assert report.duplicate_count(rows(spark, texts), 0.75).first()["pairs"] == len(want)


def test_orders_that_differ_are_counted(spark, monkeypatch):
    monkeypatch.setattr(report, "RANGES", 3)
    a, b = "babcca", "ccba"  # 0.4 one way round, 0.6 the other
    texts = random.Random(1).choices([a, b], k=40)
    assert {difflib.SequenceMatcher(None, x, y).ratio() for x, y in ((a, b), (b, a))} == {0.4, 0.6}
    assert report.duplicate_count(rows(spark, texts), 0.5).first()["pairs"] == len(brute(texts, 0.5))
    assert top(spark, texts[:12], 0.5, 60) == brute(texts[:12], 0.5)


def test_a_search_ends_at_the_level_that_has_enough(spark, monkeypatch):
    base = ["".join(random.Random(i).choices("abcdefghijklmnopqrst", k=40)) for i in range(30)]
    texts = base + [t + "#" for t in base[:10]] + [t[:-12] + "#" * 12 for t in base[10:]]
    levels = []
    candidates = S.ratio_candidates
    monkeypatch.setattr(S, "ratio_candidates", lambda a, b, t, space: levels.append(t) or candidates(a, b, t, space))
    assert top(spark, texts, 0.6, 10) == brute(texts, 0.6)[:10] and levels == [0.95]
    levels.clear()
    assert top(spark, texts, 0.6, 12) == brute(texts, 0.6)[:12] and levels[-1] < 0.95


def test_hot_stems(spark):
    n = 60_000
    df = spark.range(n).selectExpr("id", "case when id % 2 = 0 then 'one generic stem' else 'one generic stem!' end as stem_norm", "array('x') as options", "'A' as answer")
    got = [(r["a_id"], r["b_id"], r["ratio"]) for r in report.top_duplicates(df, 0.75, 20).collect()]
    assert got == [(0, 2 * i, 1.0) for i in range(1, 21)]
    assert report.duplicate_count(df, 0.75).first()["pairs"] == n * (n - 1) // 2
    similar = df.where("id in (3, 9) or (id % 2 = 0 and id < 7) or id > 59990").withColumn("stem_norm", df.stem_norm)
    assert report.top_duplicates(similar, 0.75, 1000, Workspace(spark)).count() == similar.count() * (similar.count() - 1) // 2


@pytest.mark.parametrize("t", [0.9, 0.95])
def test_candidates_by_grams_of_several_sizes_miss_nothing(spark, tmp_path, t):
    r = random.Random(3)
    base = ["".join(r.choices("abc", k=n)) for n in (1, 3, 9, 12, 15, 16, 18, 19, 20, 23, 24, 40, 60)]
    texts = sorted({x for s in base for x in (s, s + "a", s[1:] + "b", s[:5] + "c" + s[5:], s[:-2])} - {""})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    space = Workspace(spark, str(tmp_path))
    got = {tuple(x) for x in S.ratio_candidates(df, df, t, space).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if difflib.SequenceMatcher(None, a, b).ratio() >= t}
    assert want <= got
    assert space.made == 0  # before, all grams of all strings were written, and joined with their frequencies


def test_many_passes_find_what_one_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PASS_GRAMS", 2000)
    texts = random.Random(7).choices(strings(40, 4), k=60) + ["".join(random.Random(i % 9).choices("abcdefgh", k=44)) + "#" * (i % 5) for i in range(40)]
    want = brute(texts, 0.9)
    space = Workspace(spark, str(tmp_path))
    assert top(spark, texts, 0.9, 100_000, space) == want and len(want) > 40
    assert sum(p.name.endswith("-pass") for p in tmp_path.glob("work-*/*")) > 1
    assert report.duplicate_count(rows(spark, texts), 0.9).first()["pairs"] == len(want)


def test_a_join_shuffles_neither_characters_nor_strings_that_fit_no_length(spark, tmp_path):
    r = random.Random(2)
    texts = ["".join(r.choices("abcdefghijklmnop", k=44)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    plan = S.ratio_candidates(df, df, 0.9, Workspace(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "strategy=merge" in plan  # before, arrays of all characters of both sides; and grams were broadcast
    longer = df.selectExpr("id", "concat(s, substr(s, 1, 20)) as s")
    none = S.ratio_candidates(df, longer, 0.9, Workspace(spark, str(tmp_path)))
    assert "Join" not in none._jdf.queryExecution().optimizedPlan().toString() and none.isEmpty()
    one = S.ratio_candidates(df, df, 0.9, Workspace(spark, str(tmp_path)))
    assert one.where("a_id < b_id").isEmpty() and one.count() == len(texts)


def test_parities_rule_out_what_shares_a_gram_by_chance(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=44)) for _ in range(4000)]
    texts += [t[:20] + "#" + t[21:] for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    counts = spark.sparkContext.broadcast(S.gram_counts(df, 4))
    side = S._prefixes(df, 0.9, 4, counts, True, 1, 0)
    met = side.select("gram", F.col("id").alias("a")).join(side.select("gram", F.col("id").alias("b")), "gram").where("a < b").distinct().count()
    assert S._joined(side, side, 0.9, 4, True).count() == 50 and met > 500
