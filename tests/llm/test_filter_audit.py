import itertools
import random
import re

import duckdb

from stemforge.llm import filter_audit
from stemforge.llm.oracles import FILTER_AUDIT

DOCUMENTS, LABELS = "doc_id long, source string, text string, part string, mask int", "doc_id long, quality int, toxic int, n int"
FIELDS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(i, text, rows):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows),
    }


def brute(rows, labels):
    lost = lambda i, k: int(i is not None and any(j == i and x[k] == 1 for j, *x in labels))
    masks = [(s or "", fails(i, t or "", rows), lost(i, 0), lost(i, 1)) for i, s, t in rows]
    out = []
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        counts, total = {}, dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [any(m[1][x] for x in order[:k]) for m in mine]
                here = [m for m, g in zip(mine, gone) if m[1][f] and not g]
                total[f] += len(here)
                counts[order, k + 1] = (
                    sum(not g and not m[1][f] for m, g in zip(mine, gone)), len(here), sum(g and m[1][f] for m, g in zip(mine, gone)),
                    sum(m[1][f] and sum(m[1].values()) == 1 for m in mine), sum(m[2] for m in here), sum(m[3] for m in here),
                )
        out += [(part, o, k, *c, total[o[k - 1]]) for (o, k), c in counts.items()]
    return sorted(out)


def sample():
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        text = " ".join(r.choices(words[: r.choice([15, 200])], k=r.choice([10, 60, 90])))
        text = text.upper() if r.random() < 0.3 else text
        text += r.choice(["", "", " #", "\x0b|"])
        rows.append((i, r.choice(["a", "b", "", None]), text))
    rows += [(200 + i, "a", rows[i][2]) for i in range(20)] + [(5, "b", rows[5][2]), (5, "b", "other"), (None, "a", rows[0][2]), (None, "c", None), (300, None, ""), (301, "c", None), (302, "Ç" + "x" * 10, "É " * 30_000)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def found(df):
    return sorted(tuple(r) for r in df.select(*FIELDS).collect())


def test_brute_force_and_sql(spark):
    rows, labels = sample()
    documents, known = spark.createDataFrame([(*x, "q", 7) for x in rows], DOCUMENTS), spark.createDataFrame([(*x, 1) for x in labels], LABELS)
    got = filter_audit.audit(documents, known)
    assert got.columns == FIELDS and found(got) == brute(rows, labels)
    c = duckdb.connect()
    c.register("documents", documents.toPandas().astype({"doc_id": "Int64"}))
    c.register("labels", known.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert sorted(c.sql(f"select {', '.join(FIELDS)} from ({FILTER_AUDIT})").fetchall()) == brute(rows, labels)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS)
    assert found(filter_audit.audit(none, labels)) == []
    one = spark.createDataFrame([(1, "s", None, "", 0)], DOCUMENTS)
    got = found(filter_audit.audit(one, labels))
    assert len(got) == 600 and {(r[4], r[9]) for r in got if r[1][r[2] - 1] == "A"} == {(1, 120)} and all(r[4] == 0 for r in got if r[1][r[2] - 1] != "A")
