import json
import tempfile

import pytest

from stemforge.bank import Bank
from stemforge.operators import maintenance, report
from stemforge.operators.capture import Fold
from stemforge.sources.tables import Store
from stemforge.streaming import ingest

PAPER = "1、[1分]\n学生公寓晚上几点熄灯呢()\nA. 十点\nB. 十一点\n正确答案：B\n2、[1分]\n借书最多可以续借几次呢\nA. 一次\nB. 两次\n正确答案：A\n\n没有答案的块\n"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper_id long, text string")


def test_a_banks_life(spark, folder):
    bank = Bank(spark, folder)
    done = bank.learn(papers(spark, PAPER), "甲")
    assert done["tally"].first().asDict() == {"batch_id": 0, "insert": 2, "update": 0, "skip": 0, "conflict": 0}
    assert done["failures"].count() == 1 and done["repeats"].count() == 0
    done = bank.learn(papers(spark, PAPER.replace("正确答案：B", "正确答案：A")), "乙")
    assert done["tally"].first().asDict() == {"batch_id": 1, "insert": 0, "update": 1, "skip": 0, "conflict": 1}
    assert [r["kind"] for r in done["repeats"].collect()] == ["across", "across"]
    assert [(r["old_answer"], r["new_answer"]) for r in bank.conflicts().collect()] == [("B", "A")]
    asked = bank.ask(spark.createDataFrame([(1, "学生公寓晚上几点熄灯呢\nA. 十一点\nB. 十点")], "query_id long, text string")).first()
    assert asked["best"]["letters"] == "A"
    graded = bank.grade(spark.createDataFrame([(1, 1, "b"), (2, 2, "b"), (3, 2, " ")], "attempt_id long, id long, given string"))
    assert sorted((r["id"], r["ok"]) for r in graded.collect()) == [(1, True), (2, False)]
    s = bank.stats().first()
    assert (s["questions"], s["sightings"], s["once"], s["hot"], s["shaky"], s["bad"], s["conflicts"]) == (2, 4, 0, 0, 1, 1, 1)
    assert [r["id"] for r in bank.practice(2).collect()] == [2, 1]
    bank.export(f"{folder}/out")
    rows = [json.loads(r[0]) for r in spark.read.text(f"{folder}/out").collect()]
    assert sorted(rows[0]) == ["answer", "answer_text", "explanation", "id", "options", "stem", "times_seen", "wrong_count"]
    assert bank.clear("甲", confirmed=True)["decision"] == maintenance.REFUSE
    assert bank.forget(fragment="公寓", confirmed=True).count() == 1
    plan = bank.clear(everything=True, confirmed=True)
    assert spark.read.parquet(plan["backup"]).count() == 1
    bank.learn(papers(spark, PAPER), "丙")
    fold = bank.fold()
    assert bank.questions(fold).count() == 2 and fold.conflicts.count() == 1


def test_clear_guard(spark):
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)], "source string")
    assert maintenance.clear_plan(rows, "a").first()["decision"] == "refuse"
    rows = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "source string")
    assert maintenance.clear_plan(rows, "a").first()["decision"] == "delete"
    assert maintenance.clear_plan(rows, None).first()["decision"] == "nothing"


def test_forget_needs_a_selector_and_takes_wildcards(spark):
    rows = spark.createDataFrame([(1, "Ab c", "abc"), (2, "xyz", "xyz")], "id long, stem_raw string, stem_norm string")
    assert [r["id"] for r in maintenance.forget_matches(rows, fragment="B_c").collect()] == [1]
    assert [r["id"] for r in maintenance.forget_matches(rows, ids=[2]).collect()] == [2]
    with pytest.raises(ValueError):
        maintenance.forget_matches(rows, fragment=" ")


def test_by_source(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "source string")
    assert [tuple(r) for r in report.by_source(rows).collect()] == [("c", 2), (None, 1), ("a", 1), ("b", 1)]


def test_stream_of_papers(spark, folder):
    import pathlib

    inbox = pathlib.Path(folder, "inbox")
    inbox.mkdir()
    (inbox / "a.txt").write_text(PAPER, encoding="utf-8")
    store = Store(spark, f"{folder}/store")
    run = lambda: ingest.ingest(ingest.paper_stream(spark, str(inbox)), store, f"{folder}/checkpoint").awaitTermination()
    run()
    assert store.read("captures").count() == 2
    (inbox / "b.txt").write_text(PAPER.replace("借书", "还书"), encoding="utf-8")
    run()
    run()
    assert store.read("captures").count() == 4
    assert Bank(spark, f"{folder}/store").questions().count() == 3


def test_learning_and_streams_share_an_order(spark, folder):
    import pathlib

    bank = Bank(spark, f"{folder}/store")
    bank.learn(papers(spark, PAPER), "甲")
    inbox = pathlib.Path(folder, "inbox")
    inbox.mkdir()
    (inbox / "a.txt").write_text(PAPER.replace("借书", "还书"), encoding="utf-8")
    for name in ("one", "two", "one"):
        ingest.ingest(ingest.paper_stream(spark, str(inbox)), bank.store, f"{folder}/{name}").awaitTermination()
    assert sorted((r["batch_id"], r["source"]) for r in bank.store.read("captures").collect()) == [(0, "甲")] * 2 + [(1, "stream")] * 2 + [(2, "stream")] * 2
    assert bank.learn(papers(spark, PAPER), "乙")["tally"].first()["batch_id"] == 3
    assert [(r["stem_raw"][:2], r["times_seen"]) for r in bank.questions().orderBy("id").collect()] == [("学生", 4), ("借书", 2), ("还书", 2)]


def test_a_batch_that_comes_again_replaces_itself(spark, folder):
    store = Store(spark, folder)
    assert [store.claim("a", 0), store.claim("b", 0), store.claim("a", 1), store.claim("a", 0), store.claim("b", 0)] == [0, 1, 2, 0, 1]
    bank = Bank(spark, folder)
    for _ in range(2):
        bank.learn(papers(spark, PAPER), "x", batch_id=7)
    assert store.read("captures").count() == 2 and store.last_batch() == 3
    with pytest.raises(ValueError):
        store.append("captures", store.read("captures"))


def test_strict_conflicts(spark):
    from tests.test_capture import SCHEMA, STEM

    rows = lambda xs: spark.createDataFrame([(0, i, "s", STEM, o, a, None, None, None) for i, (o, a) in enumerate(xs)], SCHEMA)
    count = lambda xs, strict: Fold(rows(xs), strict=strict).conflicts.count()
    changed, shuffled = [(["x", "y"], "A"), (["y", "x"], "A")], [(["x", "y", "z"], "AB"), (["z", "y", "x"], "BC")]
    assert [count(changed, False), count(changed, True), count(shuffled, False), count(shuffled, True)] == [0, 1, 1, 0]
    assert count([([], "A"), (["x"], "A"), (["x"], "B")], True) == 1


def test_session_score_and_pairs_as_shown(spark):
    graded = spark.createDataFrame([(1, True), (1, False), (1, True), (2, False)], "session long, ok boolean")
    assert sorted(tuple(r) for r in report.session_score(graded, "session").collect()) == [(1, 2, 1, "本轮 对 2 / 错 1"), (2, 0, 1, "本轮 对 0 / 错 1")]
    pairs = spark.createDataFrame([(1, 2, 0.9)], "a_id long, b_id long, ratio double")
    questions = spark.createDataFrame([(1, "x" * 70, "y" * 60), (2, "z", None)], "id long, stem_raw string, answer_text string")
    r = report.shown_pairs(pairs, questions).first()
    assert (r["a_stem"], r["a_text"], r["b_stem"], r["b_text"]) == ("x" * 66, "y" * 58, "z", None)
