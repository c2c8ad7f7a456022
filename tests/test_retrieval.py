import difflib
import random

from stemforge.functions import patterns as P
from stemforge.operators import lookup, report
from stemforge.operators import similarity as S
from stemforge.sources.tables import Workspace


#: The table of scores: which strings, and what they score by their lengths, longest common run and ratio.
TABLE = [
    (lambda q, c, run: q == c, lambda q, c, run, ratio: 1.0),
    (lambda q, c, run: run == len(q) < len(c) or (len(q) < len(c) and run >= 0.999 * len(q)), lambda q, c, run, ratio: 0.9 + 0.1 * len(q) / len(c)),
    (lambda q, c, run: run >= 0.999 * len(c), lambda q, c, run, ratio: 0.9 + 0.1 * len(c) / len(q)),
    (lambda q, c, run: True, lambda q, c, run, ratio: max(ratio, 0.9 * (run / len(c)))),
]


def expected_score(q, c):
    m = difflib.SequenceMatcher(None, q, c)
    run = m.find_longest_match().size
    return next(score for test, score in TABLE if test(q, c, run))(q, c, run, m.ratio())


def strings(n, seed, alphabet="abcdefg"):
    random.seed(seed)
    base = ["".join(random.choices(alphabet, k=random.randint(1, 40))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        s = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            s[random.randrange(len(s))] = random.choice(alphabet)
        cut = random.randint(0, 3)
        out.append("".join(s)[cut:] or "a")
    return sorted(set(out))


def test_pruning_loses_no_pair(spark):
    texts = strings(90, 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    for t in (0.5, 0.75, 0.85):
        kept = {(r["a_id"], r["b_id"]) for r in S.ratio_candidates(rows, rows, t, Workspace(spark)).collect()}
        want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if difflib.SequenceMatcher(None, a, b).ratio() >= t}
        assert want <= kept


def test_lookup_is_that_of_brute_force(spark):
    stems, queries = strings(60, 2), strings(40, 3) + ["", "..."]
    stored = spark.createDataFrame([(i, s) for i, s in enumerate(stems)], "id long, stem_norm string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    for least in (0.5, 0.85):
        got = {}
        for r in lookup.lookup(asked, stored, 3, least).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for i, q in enumerate(queries):
            scored = sorted(((expected_score(q, s), j) for j, s in enumerate(stems)), key=lambda x: (-x[0], x[1])) if q.strip(".") else []
            exact = [(1.0, j) for s, j in scored if s == 1.0 and stems[j] == q]
            want = exact or [(s, j) for s, j in scored if s >= least][:3]
            assert [(s, j) for _, j, s in sorted(got.get(i, []))] == want, q


def test_duplicate_pairs_are_those_of_brute_force(spark):
    texts = strings(60, 5) + ["abcabc", "abcabc"]
    rows = spark.createDataFrame([(i, t, ["x", "y"], "A" if i % 2 else "a") for i, t in enumerate(texts)], "id long, stem_norm string, options array<string>, answer string")
    got = {(r["a_id"], r["b_id"]): r["ratio"] for r in report.duplicate_pairs(rows, 0.75).collect()}
    want = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            ratio = difflib.SequenceMatcher(None, a, texts[j]).ratio()
            if ratio >= 0.75 and min(len(a), len(texts[j])) / max(len(a), len(texts[j])) >= 0.6:
                want[i, j] = ratio
    assert got == want


def test_remap(spark):
    stored = ["一年", "三年", "两年", "四年"]
    cases = [
        (stored, "C", ["一年", "三年", "两年", "四年"], "C", ["两年"], ""),
        (stored, "C", ["三年", "两年", "四年", "一年"], "B", ["两年"], ""),
        (stored, "C", ["一年", "三年", "四年", " 两年。"], "D", ["两年"], ""),
        (stored, "C", None, None, ["两年"], P.NO_OPTIONS),
        (stored, "C", ["五年"], None, ["两年"], P.MISSING_BEFORE + "两年" + P.MISSING_AFTER),
        (stored, "H", ["五年"], None, [], P.INCOMPLETE),
        (None, "对", ["错", "对"], "B", ["对"], ""),
        (None, "", ["错"], None, [], P.NO_TEXT),
        (["甲", "乙", "丙"], "CA", ["丙", "乙", "甲"], "AC", ["丙", "甲"], ""),
        (["学校教务处"], "A", ["院办", "教务处"], "B", ["学校教务处"], ""),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, options array<string>, answer string, given array<string>")
    got = lookup.with_remap(rows).orderBy("i").collect()
    assert [(r["letters"], r["texts"], r["why"]) for r in got] == [c[3:] for c in cases]
    assert set(lookup.with_remap(rows).columns) == {"i", "options", "answer", "given", "letters", "texts", "why"}


def test_ask(spark):
    stored = spark.createDataFrame([(1, "大学学制一般是几年时间", "大学学制一般是几年时间", ["一年", "三年", "两年", "四年"], "D"), (2, "大学学制一般是几年时间", "大学学制一般是几年时间", ["甲", "乙"], "A")], "id long, stem_raw string, stem_norm string, options array<string>, answer string")
    asked = spark.createDataFrame([(1, "大学学制一般是几年时间？\nA. 四年\nB. 一年"), (2, "完全无关的另外一道题目内容"), (3, None)], "query_id long, text string")
    got = {r["query_id"]: r for r in lookup.ask(asked, stored).collect()}
    assert got[1]["found"] and got[1]["best"]["letters"] == "A" and [c["letters"] for c in got[1]["candidates"]] == ["A", None]
    assert (got[2]["found"], got[2]["reason"], got[2]["best"], got[2]["candidates"]) == (False, P.NOT_FOUND, None, [])
    assert not got[3]["found"]


def test_option_overlap(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["甲", "乙", "丙"], ["甲", "乙", "丁", "戊"]), ([], ["甲"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(report.option_overlap(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]


def test_parts_are_found_by_few_candidates(spark):
    """Stems that differ in a number at their ends are told apart by the gram that holds it."""
    stems = [f"which part is {name} number {i}".replace(" ", "") for i in range(1500) for name in ["blue almond", "antique rose"][i % 2 :][:1]]
    queries = [s.removeprefix("whichpartis") for s in stems]
    rows = lambda xs: spark.createDataFrame(list(enumerate(xs)), "id long, s string")
    space = Workspace(spark)
    true = sum(q in s for q in queries for s in stems)
    assert S.containing_candidates(rows(queries), rows(stems), 1.0, space).count() == true
    assert true <= S.anchored(rows(queries), rows(stems), 1.0, space).count() <= 2 * true


def test_windows_choose_the_same_grams_in_both_texts(monkeypatch):
    r = random.Random(8)
    for gram, window in S.WINDOWS:
        span = gram + window - 1
        for _ in range(30):
            part = "".join(r.choices("abcd", k=span + r.randint(0, 9)))
            texts = ["".join(r.choices("abcd", k=r.randint(0, 80))) + part + "".join(r.choices("abcd", k=r.randint(0, 80))) for _ in range(2)]
            piece, hashes = S.chosen_grams([part, *texts, ""], gram, window)
            own, *others = ({int(h) for h in hashes[piece == i]} for i in range(3))
            assert own and all(own <= x for x in others)


def test_long_strings_are_cut_where_windows_overlap(spark, monkeypatch):
    monkeypatch.setattr(S, "HASHED", 64)
    r = random.Random(9)
    big = ["".join(r.choices("abcdefgh", k=k)) for k in (700, 64, 65, 90)]
    small = [b[k : k + n] for b in big for k in (0, 31, 60) for n in (20, 40, 70, 300) if k + n <= len(b)]
    rows = lambda xs: spark.createDataFrame(list(enumerate(xs)), "id long, s string")
    got = {tuple(x) for x in S.containing_candidates(rows(small), rows(big), 1.0, Workspace(spark)).collect()}
    assert got == {(i, j) for i, a in enumerate(small) for j, b in enumerate(big) if a in b}
