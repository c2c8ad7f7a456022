import random
import re

from pyspark.sql import functions as F

from stemforge.operators import capture
from stemforge.operators.capture import Fold, numbered

SCHEMA = "batch_id long, seq long, source string, stem string, options array<string>, answer string, qtype string, explanation string, seen_at timestamp"
STEM = "学生公寓晚上几点熄灯以及几点开门"


def fold(spark, rows, tombstones=None):
    return Fold(spark.createDataFrame([(b, s, "src", stem, o, a, None, None, None) for b, s, stem, o, a in rows], SCHEMA), tombstones)


def sequential(rows):
    """The same fold as a plain loop: outcome of each row and final (answer, options, text) by stem."""
    text = lambda a, o: " / ".join(o[ord(c) - 65] for c in re.findall("[A-H]", a) if ord(c) - 65 < len(o)) or None if o else None
    state, out = {}, {}
    for b, s, stem, o, a in sorted(rows, key=lambda r: (r[0], r[1])):
        o = o or []
        if not stem or not a:
            out[b, s] = "skip"
        elif stem not in state:
            out[b, s], state[stem] = "insert", (a, o, text(a, o))
        else:
            old_a, old_o, _ = state[stem]
            old_t = text(old_a, old_o)
            if old_a == a or (old_t and old_t == text(a, o)):
                out[b, s], state[stem] = "update", (a, o or old_o, text(a, o))
            else:
                out[b, s] = "conflict"
    return out, state


def test_states_in_order(spark):
    f = fold(spark, [(0, 1, STEM, ["x", "y"], "A"), (0, 2, STEM, ["y", "x"], "B"), (0, 3, STEM, ["y", "x"], "A"), (0, 4, STEM, [], "B"), (0, 5, STEM, None, "")])
    assert [(r["seq"], r["outcome"]) for r in f.outcomes.orderBy("seq").collect()] == [(1, "insert"), (2, "update"), (3, "conflict"), (4, "update"), (5, "skip")]
    q = f.questions.first()
    assert (q["answer"], q["options"], q["answer_text"], q["times_seen"]) == ("B", ["y", "x"], None, 4)
    c = f.conflicts.first()
    assert (c["old_answer"], c["new_answer"], c["seq"]) == ("B", "A", 3)
    assert f.tally.first().asDict() == {"batch_id": 0, "insert": 1, "update": 2, "skip": 1, "conflict": 1}


def test_equal_letters_hide_a_changed_text_and_shuffled_letters_of_several_conflict(spark):
    f = fold(spark, [(0, 1, STEM, ["x", "y"], "A"), (0, 2, STEM, ["y", "x"], "A")])
    assert f.questions.first()["answer_text"] == "y"
    f = fold(spark, [(0, 1, STEM, ["x", "y", "z"], "AB"), (0, 2, STEM, ["z", "y", "x"], "BC")])
    assert f.conflicts.count() == 1


def test_chunks_agree_with_a_loop(spark, monkeypatch):
    monkeypatch.setattr(capture, "CHUNK", 3)
    random.seed(4)
    rows = []
    for b in range(4):
        for s in range(40):
            options = random.choice([["x", "y", "z"], ["y", "x", "z"], ["z", "x"], []])
            rows.append((b, s, random.choice([STEM, STEM + "二", STEM + "三"]), options, random.choice(["A", "B", "C", "AB", ""])))
    f = fold(spark, rows)
    outcomes, state = sequential(rows)
    assert {(r["batch_id"], r["seq"]): r["outcome"] for r in f.outcomes.collect()} == outcomes
    assert {r["stem_raw"]: (r["answer"], r["options"] or [], r["answer_text"]) for r in f.questions.collect()} == state


def test_chunks_are_bounded_and_few(spark, monkeypatch):
    monkeypatch.setattr(capture, "CHUNK", 4)
    rows = [(0, i << 20, STEM, ["x"], "A") for i in range(40)] + [(0, (i << 20) + 1, STEM + "二", ["x"], "A") for i in range(3)] + [(1, i if i < 60 else 10**9 + i, STEM, ["x"], "A") for i in range(64)]
    f = fold(spark, rows)
    sizes = {(r["fold_key"], r["batch_id"], r["part"]): len(r["outcomes"]) for r in f.chunks.collect()}
    assert max(sizes.values()) <= 8 and len([k for k in sizes if k[1] == 0]) == 11 and sum(sizes.values()) == len(rows)
    assert f.questions.where("times_seen = 104").count() == 1


def test_repeats_and_ids(spark):
    rows = [(0, 0, STEM, [], "A"), (0, 1, STEM + "二", [], ""), (0, 2, STEM, [], "A"), (1, 0, STEM, [], "A"), (1, 1, STEM + "二", [], "A"), (1, 2, STEM, [], "A"), (2, 0, STEM + "二", [], "A")]
    f = fold(spark, rows)
    assert sorted((r["batch_id"], r["seq"], r["kind"]) for r in f.repeats.collect()) == [(0, 2, "within"), (1, 0, "across"), (1, 2, "within"), (2, 0, "across")]
    assert {r["stem_raw"]: r["id"] for r in numbered(f.questions).collect()} == {STEM: 1, STEM + "二": 2}


def test_tombstones_end_a_life(spark):
    marks = spark.createDataFrame([], "stem_key string, batch_id long")
    rows = [(0, 0, STEM, [], "A"), (0, 1, STEM, [], "B"), (1, 0, STEM, [], "B")]
    key = fold(spark, rows, marks).questions.first()["stem_key"]
    f = fold(spark, rows, spark.createDataFrame([(key, 0)], "stem_key string, batch_id long"))
    assert [(r["answer"], r["times_seen"]) for r in f.questions.collect()] == [("B", 1)]
    assert f.conflicts.count() == 1
    f = fold(spark, rows, spark.createDataFrame([(key, 1)], "stem_key string, batch_id long"))
    assert f.questions.count() == 0


def test_no_captures(spark):
    f = fold(spark, [])
    assert f.questions.count() == f.conflicts.count() == f.outcomes.count() == f.repeats.count() == f.tally.count() == 0


def test_ids_are_dense_over_batches_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(capture, "RANGES", 4)
    places = [(b, s * s * 7) for b in (0, 2, 5) for s in range(b, 12)]
    rows = spark.createDataFrame([(b, s, "x") for b, s in places], "first_batch long, first_seq long, stem string").repartition(3)
    got = numbered(rows)
    assert got.columns == ["id", "first_batch", "first_seq", "stem"]
    assert [(r["first_batch"], r["first_seq"]) for r in got.orderBy("id").collect()] == sorted(places) and [r["id"] for r in got.orderBy("id").collect()] == list(range(1, len(places) + 1))


def test_equal_answers_need_no_fold(spark):
    """questions whose captures all have one answer are told by aggregates, and repeats need no fold at all."""
    rows = [(b, s, STEM + "二" * (s % 3), o, "A") for b in range(3) for s, o in enumerate([["x", "y"], [], ["y", "x"], ["z"], None])]
    f = fold(spark, rows)
    assert f.repeats.count() == 12
    assert not [t for t in f.__dict__ if t in ("chunks", "contested")]
    outcomes, state = sequential(rows)
    assert {(r["batch_id"], r["seq"]): r["outcome"] for r in f.outcomes.collect()} == outcomes
    assert {r["stem_raw"]: (r["answer"], r["options"] or [], r["answer_text"]) for r in f.questions.collect()} == state
    assert f.conflicts.count() == 0 and f.contested is None
    mixed = fold(spark, [*rows, (3, 0, STEM, ["x", "y"], "B")])
    assert mixed.contested.select("fold_key").distinct().count() == 1 and mixed.conflicts.count() == 1


def test_only_texts_that_need_it_go_to_python(spark):
    """F16: rows are prepared in the JVM, and only those with combining characters by Python; both as prepared says."""
    from stemforge.sources.tables import Workspace

    stems = [STEM, "plain ASCII stem", "café au lait longer", "가 jamo in a stem", "short", "é"]
    rows = [(0, i, "s", s, o, a, None, None, None) for i, (s, o, a) in enumerate((s, o, a) for s in stems for o in (["x", "é"], ["x", "y"], None) for a in ("A", "é", "(b)"))]
    captures = spark.createDataFrame(rows, SCHEMA)
    space = Workspace(spark)
    got = capture.prepared_table(captures, space)
    want = capture.prepared(captures)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert space.made == 2
    capture.prepared_table(captures.where("seq in (0, 1, 9)").withColumn("options", F.array()).withColumn("answer", F.lit("A")), space)
    assert space.made == 3
    plan = capture.prepared(captures, False)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "pythonUDF" not in plan
