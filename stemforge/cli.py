"""python -m stemforge.cli FOLDER COMMAND ...: the bank's operations from a shell."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from stemforge.bank import Bank
from stemforge.operators import report
from stemforge.sources.tables import merge_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemforge")
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    learn = sub.add_parser("learn", help="read papers from text files")
    learn.add_argument("files", nargs="+")
    learn.add_argument("--source", default="script")
    for name, least, help_ in (("ask", 0.85, "answer a pasted question"), ("find", 0.5, "search loosely")):
        c = sub.add_parser(name, help=help_)
        c.add_argument("text", nargs="?")
        c.add_argument("--min", type=float, default=least)
        if name == "find":
            c.add_argument("--top", type=int, default=5)
    dupes = sub.add_parser("dupes", help="pairs of similar questions")
    dupes.add_argument("--min", type=float, default=0.75)
    dupes.add_argument("--top", type=int, default=20)
    clear = sub.add_parser("clear", help="delete all questions, or those of a source")
    clear.add_argument("--all", action="store_true")
    clear.add_argument("--source")
    clear.add_argument("--yes", action="store_true")
    forget = sub.add_parser("forget", help="delete single questions")
    forget.add_argument("ids", nargs="*", type=int)
    forget.add_argument("--stem")
    forget.add_argument("--yes", action="store_true")
    quiz = sub.add_parser("quiz", help="questions to practise")
    quiz.add_argument("--n", type=int, default=20)
    grade = sub.add_parser("grade", help="grade answers to questions, given as ID=ANSWER, and log them")
    grade.add_argument("answers", nargs="+")
    for name in ("stats", "conflicts", "sources"):
        sub.add_parser(name)
    export = sub.add_parser("export", help="write all questions as one JSON document")
    export.add_argument("--out", default="bank.json")
    return p


def show(rows: DataFrame, most: int = 100) -> None:
    for line in rows.toJSON().take(most):
        print(line)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stemforge").getOrCreate()
    bank = Bank(spark, a.folder)
    if a.command == "learn":
        for name, rows in bank.learn_files(a.files, a.source).items():
            print(name)
            show(rows)
    elif a.command in ("ask", "find"):
        text = a.text if a.text is not None else sys.stdin.read()
        if a.command == "ask":
            print(bank.answers(spark.createDataFrame([(0, text)], "query_id bigint, text string"), a.min).first()["text"])
        else:
            show(bank.find(spark.createDataFrame([(0, text)], "query_id bigint, query string"), a.top, a.min))
    elif a.command == "dupes":
        show(bank.duplicates(a.min, a.top), a.top)
        print(json.dumps({"left": bank.duplicates_left(a.min, a.top)}))
    elif a.command == "clear":
        if a.all or a.source:
            print(json.dumps(bank.clear(a.source, a.all, a.yes), ensure_ascii=False))
        else:
            show(bank.sources(None))
    elif a.command == "forget":
        show(bank.forget(a.ids, a.stem, a.yes))
    elif a.command == "quiz":
        show(bank.practice(a.n))
    elif a.command == "grade":
        rows = [(i, int(x.partition("=")[0]), x.partition("=")[2]) for i, x in enumerate(a.answers)]
        graded = bank.grade(spark.createDataFrame(rows, "attempt_id bigint, id bigint, given string"))
        show(graded.select("id", "given", "ok").orderBy("id"), len(rows))
        print(report.session_score(graded).first()["text"])
    elif a.command == "export":
        folder = f"{bank.space.root}/export-{uuid.uuid4().hex}"
        bank.export_document(folder)
        merge_files(spark, folder, a.out)
    else:
        show(getattr(bank, a.command)())
    return 0


if __name__ == "__main__":
    sys.exit(main())
