import math

import pytest
from pyspark.sql import functions as F

from stemforge.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, copies string"


def rows(n=4000):
    return [(i, f"text {i} " + "x" * 50, "big" if i % 4 else "small", "c") for i in range(n)]


def test_cdf(spark):
    for mean in (0.0, 0.3, 1.0, 7.5, 32.0):
        cdf = spark.range(1).select(M.poisson_cdf(F.lit(mean))).first()[0]
        want, p = [], math.exp(-mean)
        for k in range(len(cdf)):
            want.append(sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1)))
        assert max(abs(a - b) for a, b in zip(cdf, want)) < 1e-12 and cdf[-1] > 1 - 1e-12 and p >= 0


def test_weights_are_met(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    got = M.mix(docs, {"big": 1, "small": 3}, total=2 * total).groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    share = {r["source"]: r["n"] / (2 * total) for r in got}
    assert abs(share["big"] - 0.25) < 0.02 and abs(share["small"] - 0.75) < 0.03


def test_a_run_is_repeatable_and_copies_have_numbers(spark):
    docs = spark.createDataFrame(rows(300), SCHEMA)
    a = M.mix(docs, {"big": 1, "small": 1}, total=100000, copy_col="copy", order_col="o").collect()
    b = M.mix(docs.repartition(7), {"big": 1, "small": 1}, total=100000, copy_col="copy", order_col="o").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    by = {}
    for r in a:
        by.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values())
    assert len({r["o"] for r in a}) == len(a) and [r["o"] for r in a] == sorted(r["o"] for r in a)


def test_large_rates_and_weightless_sources(spark):
    docs = spark.createDataFrame([(i, "abcd", s, None) for i in range(200) for s in ("a", "b")], SCHEMA)
    got = M.mix(docs, {"a": 1}, total=200 * 4 * 100).groupBy("source").count().collect()
    assert [r["source"] for r in got] == ["a"] and abs(got[0]["count"] / 200 - 100) < 3


def test_large_means_have_the_variance_of_poisson(spark):
    docs = spark.createDataFrame([(i, "abcd", "a", None) for i in range(600)], SCHEMA)
    counts = M.mix(docs, {"a": 1}, total=600 * 4 * 200, shuffle=False).groupBy("doc_id").count().toPandas()["count"]
    assert abs(counts.mean() - 200) < 3 and 150 < counts.var() < 260


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "c"), (1, None, None, "c"), (None, "abc", "s", None), (2, "é" * 1000, "s", "c")], SCHEMA)
    got = M.mix(docs)
    assert got.columns == docs.columns
    ones = [r for r in got.collect() if r["source"] is None]
    assert len(ones) % 2 == 0  # equal rows draw alike
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rates = {r["source"]: r["rate"] for r in M.rates(docs)[0].collect()}
    assert rates[None] == 1.0 and rates["s"] == pytest.approx(1.0)


def test_sql_gives_the_same(spark):
    import duckdb

    from stemforge.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("op2_mixing", "op6_topk", "op7_chat"):
        got, want = QUERIES[name](spark, d).toPandas(), c.sql(ORACLE_SQL[name]).df()
        assert list(got.columns) == list(want.columns)
        assert sorted(map(str, got.astype(object).where(got.notna(), None).values.tolist())) == sorted(map(str, want[got.columns].astype(object).where(want.notna(), None).values.tolist())), name


def test_sql_gives_the_same_for_large_means(spark, tmp_path):
    import duckdb

    from stemforge.llm.queries import ORACLE_SQL, QUERIES

    rows = [(i, "x" * 3000, "big") for i in range(200)] + [(1000 + i, "y" * (i % 3), "small") for i in range(7)] + [(None, None, None), (5, "x" * 3000, "big")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["op2_mixing"](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL["op2_mixing"]).df()
    assert got["copy"].max() > 40
    keys = lambda frame: sorted((str(d) if d == d else "null", int(n), int(k)) for d, n, k in zip(frame.doc_id.astype(float), frame["copy"], frame.shuffle_key))
    assert keys(got) == keys(want)


def test_parts_follow_the_cluster_not_the_input(spark, monkeypatch):
    df = spark.range(300).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('x', 1 + cast(id % 50 as int)) as text")
    plain = M.mix(df, order_col="o")
    copies = sorted((r["doc_id"], r["o"]) for r in plain.collect())
    rates = M.rates
    monkeypatch.setattr(M, "rates", lambda *a, **b: (rates(*a, **b)[0], 1e14))
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    try:
        assert M.mix(df).rdd.getNumPartitions() == 19 and M.mix(df, parts=7).rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    few = M.mix(df, order_col="o", parts=3)
    assert sorted((r["doc_id"], r["o"]) for r in few.collect()) == copies
    # parts are ranges of the order, sorted within
    assert [r["o"] for r in few.collect()] == [o for o in sorted(o for _, o in copies)]
