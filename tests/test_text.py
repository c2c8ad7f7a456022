import hashlib
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemforge.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_clean_stem_removes_what_pages_add(spark):
    cases = {
        "查看试卷 冲！随机选择 一、单选题 11、[1分] 休学警告决定由()做出，试读决定由学院审核后报教务处审批发文。": "休学警告决定由()做出，试读决定由学院审核后报教务处审批发文。",
        "1978年建校": "1978年建校",
        "1、[1分] 题干": "题干",
        "班级前1/3": "班级前1/3",
        "12. （2分） 甲\n 乙": "甲\n乙",
        "第 3 题 甲": "甲",
        "共5、6项": "共5、6项",
        "  \n ": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "v string, want string").select(X.clean_stem("v").alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert one(spark, None, X.clean_stem) == ""


def test_norm(spark):
    cases = {"班级前1/3": "班级前13", "22:00": "00", "2.5": "5", "6%": "6", "我校的校训是()": "我校的校训是", "我校的校训是（）。": "我校的校训是", "ＡＢｃ　Ⅷ": "abcviii", "A b\tc": "ab\tc", "Été, déjà!": "étédéjà"}
    rows = spark.createDataFrame(list(cases.items()), "v string, want string").select(X.norm("v").alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", categories=("L", "N", "P", "Zs", "S")), max_size=12), min_size=1, max_size=30))
def test_norm_keeps_what_is_neither_punctuation_nor_separator(spark, texts):
    texts = ["x" + t + "x" for t in texts]  # nothing at the ends to clean
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", X.norm("v").alias("n"), X.clean_stem("v").alias("c")).collect()
    for r in rows:
        want = "".join(ch for ch in unicodedata.normalize("NFKC", r["c"]).lower() if unicodedata.category(ch)[0] not in "PZ")
        assert r["n"] == want


def test_norm_answer(spark):
    cases = {"A、C": "AC", "(AC)": "AC", "a c": "AC", "Ａ，Ｃ": "AC", "CA": "CA", "AAB": "AAB", "（": "", "、": "", "甲、乙": "甲、乙", "对": "对", " （b） ": "B", "none": "NONE"}
    rows = spark.createDataFrame(list(cases.items()), "v string, want string").select(X.norm_answer("v").alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert one(spark, None, X.norm_answer) == ""


def test_generic_stems_are_identified_by_their_options(spark):
    stems = ["下列说法错误的是：()", "关于勤工助学，下列说法错误的是", "我校的校训是()", "学生公寓几点熄灯以及几点开门"]
    rows = spark.createDataFrame([(s,) for s in stems], "v string").select(X.is_generic(X.norm("v"))).collect()
    assert [r[0] for r in rows] == [True, False, True, False]
    keys = spark.createDataFrame([("下列说法错误的是", ["甲", "乙"]), ("下列说法错误的是。", ["乙。", "甲"]), ("下列说法错误的是", ["甲", "丙"]), ("学生公寓几点熄灯以及几点开门", ["x"]), ("学生公寓几点熄灯，以及几点开门？", None)], "s string, o array<string>")
    a, b, c, d, e = (r[0] for r in keys.select(X.stem_key(X.norm("s"), X.norm_array("o"))).collect())
    assert a == b != c and d == e == hashlib.sha1("学生公寓几点熄灯以及几点开门".encode()).hexdigest()


def test_answer_text(spark):
    rows = spark.createDataFrame([("C", ["x", "y", "z"]), ("AD", ["x", "y", "z"]), ("H", ["x"]), ("DNA", ["w", "x", "y", "z"]), ("A", [])], "a string, o array<string>")
    got = [r[0] for r in rows.select(X.answer_text(X.norm_answer("a"), F.col("o"))).collect()]
    assert got == ["z", "x", None, "z / w", None]


def test_forms_of_options(spark):
    assert one(spark, "甲|乙｜ \n丙", X.options_of_string) == ["甲", "乙", "丙"]
    assert one(spark, {"B": "y ", "A": "x"}, X.options_of_map, "map<string,string>") == ["x", "y"]
    assert one(spark, [("x",), (None,)], X.options_of_structs, "array<struct<text:string>>") == ["x", "None"]
    assert spark.sql("select '' a, null b, 'c' c").select(X.first_filled("a", "b", "c")).first()[0] == "c"


def test_every_code_point_has_its_normal_form_in_and_out_of_the_jvm(spark):
    import random
    import unicodedata

    from pyspark.sql import functions as F

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(5)
    letters = [c for c in every if ord(c) < 0x3100 or 0x4E00 <= ord(c) < 0x4E80 or 0xF900 <= ord(c) < 0xFFFF]
    texts = ["".join(r.choices(letters[:0x3100], k=6)) for _ in range(2000)] + ["ががＡｂ１。…　ｱｶﾞ", "éÉ", "各한"]
    texts += ["".join(chr(r.choice(range(*r.choice([(0x20, 0x7F), (0xA0, 0x100), (0x2010, 0x2060), (0x3000, 0x3100), (0x4E00, 0x5000), (0xF900, 0xFB00), (0xFF01, 0xFFA0)])))) for _ in range(8)) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in [*every, *texts]], "t string").repartition(8)
    kept = rows.select("t", X.plain(F.col("t")).alias("plain"), X.bare_native(F.col("t")).alias("bare"), X.plain(F.col("t"), False).alias("exact"), F.upper(X.nfkc(F.col("t"))).alias("upper")).where("plain or exact").collect()
    wrong = [(r["t"], r["bare"]) for r in kept if r["plain"] and r["bare"] != X._bare(r["t"])]
    wrong += [(r["t"], r["upper"]) for r in kept if r["exact"] and r["upper"] != unicodedata.normalize("NFKC", r["t"]).upper()]
    assert wrong == [] and len(kept) > 29_000
    chinese = "学生公寓晚上１０点熄灯（含周末）…… “还可以”用电吗？【单选】ＡＢ，Ｃ、Ｄ"
    assert [c for c in chinese if not spark.createDataFrame([(c,)], "t string").select(X.plain(F.col("t"))).first()[0]] == []


def test_conditions_on_a_normal_form_do_not_compute_it_again(spark):
    rows = X.with_norm(spark.createDataFrame([(" 1. Ab, c",), ("ｄ",), ("é 가",), ("",)], "s string"), "n", "s").where("n <> '' and n <> 'x'")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("_bare") == 1
    assert [r["n"] for r in rows.collect()] == ["abc", "d", "é가"]


def test_white_space_at_the_ends(spark):
    given = ["", " ", "\x1c　", "a", " a b ", " x\u0085", "🙂 ", "a\n", "\x1fb"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").select("i", X.strip(F.col("s")).alias("s"), X.filled(F.col("s")).alias("filled"))
    assert [(r["s"], r["filled"]) for r in rows.orderBy("i").collect()] == [(s.strip(), s.strip() != "") for s in given]
