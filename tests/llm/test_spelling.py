import random
import re
import zlib
from collections import Counter

import pytest

from stemforge.llm import spelling


def tokens(rows, every, least_length, least_count):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(counts):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and distance_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(seed, letters="abé", size=120):
    r = random.Random(seed)
    base = ["".join(r.choices(letters, k=r.randint(6, 9))) for _ in range(size // 4)]
    words = set(base)
    while len(words) < size:
        w = list(r.choice(base))
        at = r.randrange(len(w))
        w[at : at + r.randint(0, 1)] = r.choice(["", r.choice(letters), r.choice(letters) * 2])
        words.add("".join(w))
    return {w: int(10 ** r.uniform(0.8, 4)) for w in words}


@pytest.mark.parametrize("seed", range(3))
def test_groups_are_those_of_brute_force(spark, seed):
    counts = vocabulary(seed)
    counts["x" * 9] = counts["x" * 8] = counts["x" * 10] = 7
    assert found(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == groups(counts)


def test_chains_and_ties(spark):
    chain = {"abcdefg" + "hijkl"[:i]: 5 * 5 ** i for i in range(6)}
    counts = {**chain, "zzzzzzy": 5, "zzzzzza": 40, "zzzzzzé": 40, "uuuuuu": 10, "uuuuuv": 49}
    got = found(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == groups(counts)
    by = {r[0]: r for r in got}
    assert by["abcdefg"][2] == "abcdefghijkl" and by["zzzzzzy"][1] == "zzzzzza" and by["uuuuuu"][1] is None and by["uuuuuu"][4] == 1


def test_whole_query(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 50)
    monkeypatch.setattr(spelling, "LONG_TEXT", 500)
    r = random.Random(5)
    words = [w.upper() if r.random() < 0.1 else w for w in vocabulary(9, "abcÀ÷", 80)]
    rows = [(i if i % 17 else None, " ".join(r.choices(words, k=r.randint(0, 90)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "Ünïcode日本" * 3), rows[3], rows[3], (503, "Q" * 40_000 + " ")] + [(600 + i, "q" * 39_999 + "x") for i in range(6)] + [(700 + i, "q" * 40_000) for i in range(6)]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = found(spelling.variant_groups(spelling.damaged_words(table, every=5)))
    assert got == groups(tokens(rows, 5, 6, 5)) and len(got) > 60


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.variant_groups(spelling.damaged_words(none))) == []


def test_keys_are_those_of_the_strings():
    for word in ("aab", "abcabc", "éa", "zz", "q"):
        whole = lambda s: int(spelling.deletion_keys(s)[0]) if s else 0
        keys = spelling.deletion_keys(word)
        assert int(keys[0]) == whole(word)
        assert sorted(map(int, keys[1:])) == sorted({whole(word[:i] + word[i + 1 :]) for i in range(len(word))})
