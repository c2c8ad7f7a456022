"""The driver's queries over its tables, one per operator, and the SQL that gives the same rows.

There are no exam papers among the tables, so papers are made from rows of part; the SQL reads the columns directly and never parses.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemforge.bank import Bank
from stemforge.functions import lines as L
from stemforge.functions import patterns as P
from stemforge.functions import text as X
from stemforge.operators import lookup as look
from stemforge.operators import maintenance, report
from stemforge.operators.capture import Fold, numbered
from stemforge.operators.parse import failures, parse_papers, records, records_given
from stemforge.operators.upkeep import learn_batch
from stemforge.sources.tables import Workspace, export_rows, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs made from the tables

LETTER = "substr('ABCD', cast({} % 4 + 1 as int), 1)"


def letter(c: Column) -> Column:
    return F.substring(F.lit("ABCD"), (c % 4 + 1).cast("int"), F.lit(1))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, line_no, line of every line that isn't blank."""
    documents = table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", "source", F.posexplode(X.lines_of(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
    # what is done with lines costs much more than dealing them anew where the table is in few files
    return spread(rows.where(X.filled(F.col("line"))), documents, "doc_id", "line_no")


def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_lines with stem_norm."""
    return X.with_norm(document_lines(spark, sf_dir), "stem_norm", "line")


def line_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a capture with the answer A; a document's source is its batch."""
    rows = document_lines(spark, sf_dir)
    seq = F.shiftleft(F.col("doc_id"), 20) + F.col("line_no")
    batch = F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint")
    return rows.select(batch.alias("batch_id"), seq.alias("seq"), "source", F.col("line").alias("stem"), F.lit(None).cast("array<string>").alias("options"), F.lit("A").alias("answer"), F.lit(None).cast("string").alias("qtype"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("timestamp").alias("seen_at"))


def parts(spark: SparkSession, sf_dir: str, key: str = "p_partkey") -> DataFrame:
    """The table part, dealt over the cores for work that costs more than that."""
    part = table(spark, sf_dir, "part")
    return spread(part, part, key)


def part_stem() -> Column:
    return F.concat(F.lit("which part is "), F.col("p_name"), F.lit(" number "), F.col("p_partkey").cast("string"))


def part_options() -> Column:
    return F.array("p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")), F.lit("none of these"))


def turned(options: Column, by: Column) -> Column:
    """Options with the first by of them moved to the end."""
    n = by.cast("int")
    return F.concat(F.slice(options, n + 1, F.lit(4) - n), F.slice(options, F.lit(1), n))


def option_lines(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def part_captures(spark: SparkSession, sf_dir: str, options: Column, answer: Column, stem: Column | None = None) -> DataFrame:
    part = parts(spark, sf_dir)
    return part.select(F.floor(F.col("p_partkey") / 1000).alias("batch_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("source"), (F.col("p_name") if stem is None else stem).alias("stem"), options.alias("options"), answer.alias("answer"), F.lit(None).cast("string").alias("qtype"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("timestamp").alias("seen_at"))


def part_papers(spark: SparkSession, sf_dir: str, broken: Column | None = None) -> DataFrame:
    """Papers of up to twenty questions; broken marks parts whose options are lettered A, B, A, B."""
    k = F.col("p_partkey")
    lines = option_lines(part_options())
    if broken is not None:
        lines = F.when(broken, F.regexp_replace(F.regexp_replace(lines, "\nC\\. ", "\nA. "), "\nD\\. ", "\nB. ")).otherwise(lines)
    block = F.concat((k % 1000).cast("string"), F.lit("、[1分]\n"), part_stem(), F.lit("\n"), lines, F.lit("\n正确答案："), letter(k))
    part = table(spark, sf_dir, "part")
    rows = part.select(F.floor(k / 20).alias("paper_id"), F.struct(k.alias("k"), block.alias("block")).alias("b"))
    return spread(rows, part, "paper_id").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n").alias("text"))


# --- SQL that the oracles share

LINES_SQL = "lines as (select doc_id, source, u.i - 1 as line_no, l[u.i] as line from (select doc_id, source, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as u(i) where trim(l[u.i]) <> '')"
_STRIPPED = "line"
for _ in range(3):
    _STRIPPED = f"trim(regexp_replace(regexp_replace(trim({_STRIPPED}), '^(?:第\\s*\\d{{1,4}}\\s*题|[（(\\[]?\\d{{1,3}}[）)\\].、:：,，])\\s*', ''), '^[\\[（(]\\s*\\d+\\s*分\\s*[\\]）)]\\s*', ''))"
NORM_SQL = f"regexp_replace(lower({_STRIPPED}), '[\\p{{P}}\\p{{Z}}]', '', 'g')"
NORMED_SQL = f"{LINES_SQL}, normed as (select doc_id, source, line_no, trim(line) as line, {_STRIPPED} as clean, {NORM_SQL} as stem_norm from lines)"
CAPTURED_SQL = f"{NORMED_SQL}, captured as (select *, cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) as batch from normed where clean <> '')"
PART_SQL = f"p as (select *, 'which part is ' || p_name || ' number ' || p_partkey as stem, [p_brand, p_type, 'size ' || p_size, 'none of these'] as options, {LETTER.format('p_partkey')} as letter from part)"
TURNED_SQL = "list_concat(options[(p_partkey % 4 + 1):4], options[1:(p_partkey % 4)])"


# --- text and identity


@query(f"with {NORMED_SQL} select stem_norm, count(*) as n from normed group by 1")
def norm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_lines(spark, sf_dir).groupBy("stem_norm").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with x as (
  select 'benchmark' as origin, item_id as id, regexp_replace(lower(text), '[\\p{P}\\p{Z}]', '', 'g') as norm, cast([] as varchar[]) as options from benchmark
  union all
  select 'part', p_partkey, regexp_replace(lower(p_name), '[\\p{P}\\p{Z}]', '', 'g'),
    list_sort([regexp_replace(lower(p_brand), '[\\p{P}\\p{Z}]', '', 'g'), regexp_replace(lower(p_type), '[\\p{P}\\p{Z}]', '', 'g')]) from part)
select origin, id, length(norm) < 8 as generic,
  case when length(norm) < 8 then sha1(encode(norm) || '\\x00'::blob || encode(array_to_string(options, chr(31)))) else sha1(norm) end as stem_key from x"""
)
def stem_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.col("text").alias("stem"), none.alias("options"))
    rows = rows.unionByName(table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.array("p_brand", "p_type").alias("options")))
    rows = rows.withColumn("norm", X.norm("stem"))
    return rows.select("origin", "id", X.is_generic(F.col("norm")).alias("generic"), X.stem_key(F.col("norm"), X.norm_array("options")).alias("stem_key"))


@query(f"with {PART_SQL}, v as (select p_partkey, options, list_transform([letter, lower(letter), '(' || letter || ')', 'A、' || letter, letter || ' , B'], lambda x: x) as vs, letter from p), w as (select p_partkey, options, u.i - 1 as variant, letter, vs[u.i] as given from v, unnest(range(1, 6)) as u(i)), n as (select *, case variant when 3 then 'A' || letter when 4 then letter || 'B' else letter end as answer from w) select p_partkey, variant, answer, array_to_string(list_transform(string_split(answer, ''), lambda c: options[ascii(c) - 64]), ' / ') as answer_text from n")
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = letter(F.col("p_partkey"))
    variants = F.array(x, F.lower(x), F.concat(F.lit("("), x, F.lit(")")), F.concat(F.lit("A、"), x), F.concat(x, F.lit(" , B")))
    rows = parts(spark, sf_dir).select("p_partkey", part_options().alias("options"), F.posexplode(variants).alias("variant", "given"))
    rows = rows.withColumn("answer", X.norm_answer("given"))
    return rows.select("p_partkey", "variant", "answer", X.answer_text(F.col("answer"), F.col("options")).alias("answer_text"))


# --- parsing


@query(f"with {PART_SQL} select p_partkey // 20 as paper_id, row_number() over (partition by p_partkey // 20 order by p_partkey) - 1 as block_no, stem, array_to_string(options, '|') as options, letter as answer from p")
def parsed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(parse_papers(part_papers(spark, sf_dir))).select("paper_id", F.col("block_no").cast("bigint").alias("block_no"), "stem", F.array_join("options", "|").alias("options"), "answer")


@query(f"with {PART_SQL}, n as (select *, row_number() over (partition by p_partkey // 20 order by p_partkey) - 1 as block_no from p) select p_partkey // 20 as paper_id, block_no, stem || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'A. size ' || p_size || chr(10) || 'B. none of these' || chr(10) || '正确答案：' || letter as block from n where p_partkey % 5 = 0")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_papers(part_papers(spark, sf_dir, F.col("p_partkey") % 5 == 0))
    return failures(parsed).select("paper_id", F.col("block_no").cast("bigint").alias("block_no"), "block")


@query("""with w as (select conv_id, turn, role, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') as whole from conversations)
select u.conv_id, u.turn, u.whole as stem, a.whole as answer from w u join w a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant' and u.whole <> '' and a.whole <> ''""")
def parse_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions and the assistant's next turns as answers, each with all its lines, joined by blanks."""
    joined = F.array_join(F.filter(F.transform(X.lines_of(F.coalesce("text", F.lit(""))), X.strip), lambda x: x != ""), " ")
    turns = table(spark, sf_dir, "conversations").withColumn("whole", joined)
    asked = turns.where("role = 'user'").select("conv_id", "turn", "whole")
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("whole").alias("reply"))
    papers = asked.join(replies, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("paper_id"), F.concat(F.lit("问："), "whole", F.lit("\n答："), "reply").alias("text"))
    return records(parse_papers(papers, single=True)).select("paper_id.conv_id", "paper_id.turn", "stem", "answer")


@query(f"with {PART_SQL} select p_partkey, stem, p_brand || '|' || p_type || '|size ' || p_size as options, substr('ABC', cast(p_partkey % 3 + 1 as int), 1) as answer from p")
def parse_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose options are in one line, lettered in lower case within the stem."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("第"), (k % 1000).cast("string"), F.lit("、（2分）\n"), part_stem(), F.lit("\nA. "), "p_brand", F.lit("  B、"), "p_type", F.lit(" C) size "), F.col("p_size").cast("string"), F.lit("\n参考答案: "), F.substring(F.lit("ABC"), (k % 3 + 1).cast("int"), F.lit(1)))
    papers = parts(spark, sf_dir).select(k.alias("paper_id"), text.alias("text"))
    return records(parse_papers(papers)).select(F.col("paper_id").alias("p_partkey"), "stem", F.array_join("options", "|").alias("options"), "answer")


@query(f"with {PART_SQL} select p_partkey, stem || ' a. ' || p_brand || ' b. ' || p_type as stem, 'ab|ba' as options, substr('AB', cast(p_partkey % 2 + 1 as int), 1) as answer from p")
def parse_sub_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose stem has parts lettered in lower case, and options in upper case."""
    k = F.col("p_partkey")
    text = F.concat(part_stem(), F.lit("\na. "), "p_brand", F.lit("\nb. "), "p_type", F.lit("\nA. ab\nB. ba\n正确答案："), F.substring(F.lit("AB"), (k % 2 + 1).cast("int"), F.lit(1)))
    papers = parts(spark, sf_dir).select(k.alias("paper_id"), text.alias("text"))
    return records(parse_papers(papers)).select(F.col("paper_id").alias("p_partkey"), "stem", F.array_join("options", "|").alias("options"), "answer")


@query(f"with {PART_SQL} select p_partkey, stem as clean, lower(replace(stem, ' ', '')) as stem_norm from p")
def clean_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems with captions, a section heading and a question number before them."""
    k = F.col("p_partkey")
    noisy = F.concat(F.lit("查看试卷 冲！随机选择 二、多选题 "), (k % 100 + 1).cast("string"), F.lit("、[1分] "), part_stem(), F.lit(" 下一题"))
    return X.with_norm(parts(spark, sf_dir).select("p_partkey", noisy.alias("noisy")), "stem_norm", "noisy").select("p_partkey", X.clean_stem("noisy").alias("clean"), "stem_norm")


@query(f"with {PART_SQL} select p_partkey, stem, array_to_string(options, '|') as options from p")
def query_and_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat((k % 1000).cast("string"), F.lit("、[1分]\n"), part_stem(), F.lit("\n"), option_lines(part_options()), F.lit("\n正确答案："), letter(k))
    return parts(spark, sf_dir).select("p_partkey", L.query_from_text(text).alias("stem"), F.array_join(L.options_from_text(text), "|").alias("options"))


# --- captures


@query(f"with {CAPTURED_SQL} select stem_norm, count(*) as times_seen, arg_min(source, (batch, doc_id, line_no)) as first_source, arg_max(source, (batch, doc_id, line_no)) as last_source from captured group by stem_norm")
def capture_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = Fold(line_captures(spark, sf_dir))
    last = fold.kept.groupBy("stem_key").agg(F.max(F.struct("batch_id", "seq", "source")).alias("m"))
    return fold.questions.join(last, "stem_key").select("stem_norm", "times_seen", F.col("source").alias("first_source"), F.col("m.source").alias("last_source"))


@query(f"with {CAPTURED_SQL}, f as (select *, row_number() over (partition by stem_norm, batch order by doc_id, line_no) as rn, min(batch) over (partition by stem_norm) as first_batch from captured) select batch as batch_id, case when rn > 1 then 'within' else 'across' end as kind, count(*) as n from f where rn > 1 or first_batch < batch group by all")
def batch_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fold(line_captures(spark, sf_dir)).repeats.groupBy("batch_id", "kind").agg(F.count(F.lit(1)).alias("n"))


FIXED_OPTIONS = ["one", "two", "three", "four"]


@query(f"with c as (select p_partkey, p_name as stem_raw, first_value({LETTER.format('p_partkey')}) over (partition by lower(replace(p_name, ' ', '')) order by p_partkey) as old_answer, {LETTER.format('p_partkey')} as new_answer from part) select p_partkey, stem_raw, old_answer, new_answer from c where old_answer <> new_answer")
def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = Fold(part_captures(spark, sf_dir, F.array(*map(F.lit, FIXED_OPTIONS)), letter(F.col("p_partkey"))))
    return fold.conflicts.select(F.col("seq").alias("p_partkey"), "stem_raw", "old_answer", "new_answer")


@query(f"select arg_min(p_name, p_partkey) as stem_raw, count(*) as times_seen, arg_max({LETTER.format('(4 - p_partkey % 4)')}, p_partkey) as answer, 'one' as answer_text, 0 as conflicts from part group by lower(replace(p_name, ' ', ''))")
def conflict_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    # the options move on by k, so the text of the first one goes to another letter
    fold = Fold(part_captures(spark, sf_dir, turned(F.array(*map(F.lit, FIXED_OPTIONS)), k % 4), letter(F.lit(4) - k % 4)))
    wrong = fold.conflicts.groupBy("stem_key").agg(F.count(F.lit(1)).alias("conflicts"))
    return fold.questions.join(wrong, "stem_key", "left").select("stem_raw", "times_seen", "answer", "answer_text", F.coalesce("conflicts", F.lit(0)).cast("int").alias("conflicts"))


@query(f"with k as (select floor(p_partkey / 1000)::bigint as batch_id, p_partkey, case when p_partkey % 11 = 0 then '' else {LETTER.format('p_partkey')} end as answer, lower(replace(p_name, ' ', '')) as stem from part), f as (select *, arg_min(answer, p_partkey) filter (answer <> '') over (partition by stem) as first_answer, min(p_partkey) filter (answer <> '') over (partition by stem) as first_key from k), o as (select *, case when answer = '' then 'skip' when p_partkey = first_key then 'insert' when answer = first_answer then 'update' else 'conflict' end as outcome from f) select batch_id, count_if(outcome = 'insert')::bigint as \"insert\", count_if(outcome = 'update')::bigint as \"update\", count_if(outcome = 'skip')::bigint as skip, count_if(outcome = 'conflict')::bigint as conflict from o group by 1")
def batch_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return Fold(part_captures(spark, sf_dir, F.array(*map(F.lit, FIXED_OPTIONS)), F.when(k % 11 == 0, "").otherwise(letter(k)))).tally


@query(f"with k as (select p_partkey, p_name, p_partkey % 2 as turned, min(p_partkey) over (partition by lower(replace(p_name, ' ', ''))) % 2 as first_turned from part) select p_partkey, p_name as stem_raw, 'A' as old_answer, 'A' as new_answer from k where turned <> first_turned")
def conflict_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with the same letter whose options are the other way round: conflicts only by their texts."""
    options = F.array(*map(F.lit, FIXED_OPTIONS))
    fold = Fold(part_captures(spark, sf_dir, F.when(F.col("p_partkey") % 2 == 0, options).otherwise(F.reverse(options)), F.lit("A")), strict=True)
    return fold.conflicts.select(F.col("seq").alias("p_partkey"), "stem_raw", "old_answer", "new_answer")


def part_fold(spark: SparkSession, sf_dir: str) -> Fold:
    return Fold(part_captures(spark, sf_dir, part_options(), letter(F.col("p_partkey"))))


@query(f"with {CAPTURED_SQL}, f as (select stem_norm, count(*) as n from captured group by 1) select count(*) as questions, sum(n)::bigint as sightings, count_if(n = 1)::bigint as once, count_if(n >= 3)::bigint as hot, 0::bigint as shaky, 0::bigint as bad, 0::bigint as conflicts from f")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = Fold(line_captures(spark, sf_dir))
    attempts = spark.createDataFrame([], "stem_key string, ok boolean")
    return report.stats(report.with_attempts(fold.questions, attempts), fold.conflicts)


@query(f"with q as (select lower(replace(p_name, ' ', '')) as stem, count(*) as n, count_if(p_partkey % 16 = 0 and p_partkey % 32 <> 0) as wrong, count_if(p_partkey % 32 = 0) as good from part group by 1), c as (select first_value({LETTER.format('p_partkey')}) over (partition by lower(replace(p_name, ' ', '')) order by p_partkey) <> {LETTER.format('p_partkey')} as wrong from part) select count(*) as questions, sum(n)::bigint as sightings, count_if(n = 1)::bigint as once, count_if(n >= 3)::bigint as hot, count_if(wrong > 0)::bigint as shaky, count_if(wrong > 0 and good = 0)::bigint as bad, (select count_if(wrong) from c)::bigint as conflicts from q")
def stats_practised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a bank with conflicts and a log of attempts: every sixteenth part is one, and half of these are right."""
    k = F.col("p_partkey")
    fold = Fold(part_captures(spark, sf_dir, F.array(*map(F.lit, FIXED_OPTIONS)), letter(k)))
    attempts = fold.captures.where("seq % 16 = 0").select("stem_key", (F.col("seq") % 32 == 0).alias("ok"))
    return report.stats(report.with_attempts(fold.questions, attempts), fold.conflicts)


@query(f"with {CAPTURED_SQL}, f as (select arg_min(source, (batch, doc_id, line_no)) as source from captured group by stem_norm) select source, count(*) as questions from f group by 1 order by 2 desc, 1 limit 10")
def sources_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_source(Fold(line_captures(spark, sf_dir)).questions, 10)


@query(f"with {PART_SQL}, n as (select *, row_number() over (order by p_partkey) as id from p) select id, stem, array_to_string(options, '|') as options, letter as answer, options[ascii(letter) - 64] as answer_text, null::varchar as explanation, 1::bigint as times_seen, 0::bigint as wrong_count from n")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = Fold(part_captures(spark, sf_dir, part_options(), letter(F.col("p_partkey")), part_stem()))
    rows = report.with_attempts(numbered(fold.questions), spark.createDataFrame([], "stem_key string, ok boolean"))
    return export_rows(rows).withColumn("options", F.array_join("options", "|"))


@query(f"with {CAPTURED_SQL}, f as (select arg_min(source, (batch, doc_id, line_no)) as source from captured group by stem_norm) select source, count(*) as questions from f group by 1")
def sources_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_source(Fold(line_captures(spark, sf_dir)).questions, None)


RECORDS_SQL = f"{PART_SQL}, r as (select p_partkey, p_partkey % 4 as form, stem, letter, [p_brand, p_type, 'size ' || p_size] as options from p)"


@query(f"with {RECORDS_SQL} select p_partkey, stem, array_to_string(options, '|') as options, letter as answer, case when form = 3 then 'multi' end as qtype from r")
def record_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made records whose fields go by other names and whose options come as a string, a map, an array, or an array of structs."""
    k = F.col("p_partkey")
    three = F.array("p_brand", F.concat(F.lit(" "), "p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit("  ")))
    letters = F.array(*map(F.lit, "CAB"))
    by_letter = F.map_from_arrays(letters, F.array(three[2], three[0], three[1]))
    forms = [("stem", "options", F.array_join(three, "|")), ("题干", "选项", by_letter), ("question", "options", three), ("stem", "选项", F.transform(three, lambda o: F.struct(F.lit(1).alias("n"), o.alias("text"))))]
    found = []
    for i, (stem, options, value) in enumerate(forms):
        rows = parts(spark, sf_dir).where(k % 4 == i).select(k, part_stem().alias(stem), value.alias(options), F.lit("").alias("answer"), letter(k).alias("答案"), F.lit("multi" if i == 3 else None).cast("string").alias("题型"))
        found.append(records_given(rows, "p_partkey"))
    out = functools.reduce(DataFrame.unionByName, found)
    return out.select(F.col("seq").alias("p_partkey"), "stem", F.array_join("options", "|").alias("options"), "answer", "qtype")


# --- a stored bank


def stored_bank(captures: DataFrame, batches: int) -> Bank:
    """A new bank that has learned captures (batch_id from 0 to batches - 1), one batch after the other."""
    spark = captures.sparkSession
    bank = Bank(spark, f"{Workspace(spark).root}/bank")
    for number in range(batches):
        learn_batch(bank.store, bank.store.claim("queries", number), captures.where(F.col("batch_id") == number), bank.space)
    return bank


@query(f"with c as (select p_name, p_partkey % 3 as b, p_partkey as k, {LETTER.format('p_partkey')} as letter, lower(replace(p_name, ' ', '')) as stem from part), q as (select arg_min(p_name, (b, k)) as stem_raw, arg_min(letter, (b, k)) as answer, count(*) as times_seen, min((b, k)) as first from c group by stem) select row_number() over (order by first) as id, stem_raw, answer, times_seen from q")
def bank_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that three batches left in a stored bank, each folded into those that it touches."""
    k = F.col("p_partkey")
    captures = part_captures(spark, sf_dir, F.array(*map(F.lit, FIXED_OPTIONS)), letter(k)).withColumn("batch_id", F.col("seq") % 3)
    return stored_bank(captures, 3).store.questions().select("id", "stem_raw", "answer", "times_seen")


THIRDS_SQL = f"c as (select p_name, p_brand, p_partkey % 3 as b, p_partkey as k, {LETTER.format('p_partkey')} as letter, lower(replace(p_name, ' ', '')) as stem from part), f as (select *, first_value(letter) over (partition by stem order by b, k) as old from c)"


def thirds(spark: SparkSession, sf_dir: str) -> Bank:
    """A stored bank that has learned all parts in three batches."""
    captures = part_captures(spark, sf_dir, F.array(*map(F.lit, FIXED_OPTIONS)), letter(F.col("p_partkey"))).withColumn("batch_id", F.col("seq") % 3)
    return stored_bank(captures, 3)


@query(f"with {THIRDS_SQL} select b as batch_id, k as p_partkey, p_name as stem_raw, old as old_answer, letter as new_answer from f where old <> letter order by b desc, k desc limit 20")
def conflicts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest conflicts of a stored bank."""
    return thirds(spark, sf_dir).conflicts().select("batch_id", F.col("seq").alias("p_partkey"), "stem_raw", "old_answer", "new_answer").limit(20)


@query(f"with {THIRDS_SQL}, q as (select arg_min(p_brand, (b, k)) as source from c group by stem), d as (select count_if(source = (select min(source) from q)) as matched, count(*) as total from q) select matched::bigint as matched, total, case when matched >= 0.9 * total then 'refuse' else 'delete' end as decision, case when matched < 0.9 * total then total end as saved, case when matched >= 0.9 * total then total else total - matched end::bigint as remaining, (select count(*) from f where old <> letter) as conflicts from d")
def clear_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confirmed deletion of one source: what it says and saves, and the questions and conflicts that are left."""
    bank = thirds(spark, sf_dir)
    plan = bank.clear(bank.questions().agg(F.min("source")).first()[0], confirmed=True)
    saved = spark.read.parquet(plan["backup"]).count() if "backup" in plan else None
    said = spark.createDataFrame([(plan["matched"], plan["total"], plan["decision"], saved)], "matched bigint, total bigint, decision string, saved bigint")
    remaining, conflicts = bank.questions().agg(F.count(F.lit(1)).alias("remaining")), bank.store.conflicts().agg(F.count(F.lit(1)).alias("conflicts"))
    return said.join(F.broadcast(remaining)).join(F.broadcast(conflicts))  # one row each


RANDOM_STEM_SQL = r"regexp_replace(lower(base64(unhex(sha256(p_partkey::varchar)))), '[\p{P}\p{Z}]', '', 'g')"


@query(f"with s as (select p_partkey, {RANDOM_STEM_SQL} as stem, base64(unhex(sha256(p_partkey::varchar))) as raw, {LETTER.format('p_partkey')} as letter from part) select p_partkey as query_id, 2::bigint as hits, raw as stem, '{P.CONTAINED}' as kind, 0.9::double + (0.1::double * length(stem)) / (length(stem) + 2) as score from s union all select p_partkey, 2, raw || 'zzzz', '{P.FRAGMENT}', 0.9::double + (0.1::double * (length(stem) + 2)) / (length(stem) + 4) from s")
def ask_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored bank's index finds for every random stem with two marks at its end: the stem itself, and one with four."""
    k = F.col("p_partkey")
    random = F.base64(F.unhex(F.sha2(k.cast("string"), 256)))
    captures = part_captures(spark, sf_dir, part_options(), letter(k), random).withColumn("batch_id", F.lit(0).cast("bigint"))
    more = captures.withColumns({"stem": F.concat("stem", F.lit("zzzz")), "batch_id": F.lit(1).cast("bigint")})
    bank = stored_bank(captures.unionByName(more), 2)
    asked = table(spark, sf_dir, "part").select(k.alias("query_id"), F.concat(random, F.lit("zz")).alias("query"))
    hits = bank.find(asked, 5, 0.85)
    return hits.select("query_id", F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("hits"), F.col("stem_raw").alias("stem"), "kind", "score")


# --- retrieval


def normal_once(rows: DataFrame) -> DataFrame:
    """rows (stem_raw) with stem_norm, in a table: a search reads its questions several times, and would compute the forms each time."""
    return Workspace(rows.sparkSession).table(X.with_norm(rows, "stem_norm", "stem_raw"), "stored")


@query(f"with {PART_SQL} select p_partkey, {LETTER.format('(4 + ascii(letter) - 65 - p_partkey % 4)')} as letters, options[ascii(letter) - 64] as texts, '' as why from p")
def remap_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = parts(spark, sf_dir).select("p_partkey", part_options().alias("options"), turned(part_options(), k % 4).alias("given"), letter(k).alias("answer"))
    return look.with_remap(rows).select("p_partkey", "letters", F.array_join("texts", " / ").alias("texts"), "why")


TIERS = ["exactly {}", " exactly {} ", "Exactly, {}!", "the words exactly {} in a longer one"]


@query(f"with {PART_SQL} select p_partkey, {LETTER.format('(p_partkey + 1)')} as letters, 'exactly ' || p_name as texts, '' as why from p")
def find_option_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right option among those shown, as it is, with blanks, with other punctuation, and within a longer one."""
    k = F.col("p_partkey")
    forms = F.array(*(F.concat(F.lit(t.split("{}")[0]), "p_name", F.lit(t.split("{}")[1])) for t in TIERS))
    shown = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == (k + 1) % 4, F.element_at(forms, (k % 4 + 1).cast("int"))).otherwise(F.concat(F.lit("option "), i.cast("string"))))
    rows = parts(spark, sf_dir).select("p_partkey", F.array(F.lit("other"), F.concat(F.lit("exactly "), "p_name")).alias("options"), shown.alias("given"), F.lit("B").alias("answer"))
    return look.with_remap(rows).select("p_partkey", "letters", F.array_join("texts", " / ").alias("texts"), "why")


@query(f"with {NORMED_SQL}, b as (select item_id, {NORM_SQL.replace('line', 'part')} as stem_norm from (select item_id, unnest(string_split(text, chr(10))) as part from benchmark) where trim(part) <> '') select distinct b.item_id, n.doc_id, n.line_no from b join normed n using (stem_norm) where stem_norm <> ''")
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.lines_of(F.col("text"))).alias("line"))
    queries = X.with_norm(items, "q", "line").select(F.col("item_id").alias("query_id"), "q")
    stored = normal_lines(spark, sf_dir).select(F.struct("doc_id", F.col("line_no").cast("bigint").alias("line_no")).alias("id"), "stem_norm")
    return look.exact_hits(queries, stored).select(F.col("query_id").alias("item_id"), "id.doc_id", "id.line_no").distinct()


def benchmark_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, part_no, part: every benchmark text as a whole (number 0), then its sentences."""
    sentences = F.filter(F.split("text", r"[.!?\n]+"), lambda x: X.strip(x) != "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.concat(F.array("text"), sentences)).alias("part_no", "part"))


PARTS_SQL = f"parts as (select item_id, {NORM_SQL.replace('line', 'part')} as q from (select item_id, unnest(list_prepend(text, regexp_split_to_array(text, '[.!?\n]+'))) as part from benchmark) where trim(part) <> '')"
HELD_SQL = f"{NORMED_SQL}, {PARTS_SQL}, c as (select stem_norm as c, min(doc_id * 1048576 + line_no) as id from normed group by 1), held as (select q, c, id, 0.90::double + (0.10::double * length(q)) / length(c) as score from (select distinct q from parts where q <> ''), c where contains(c, q) and length(q) < length(c))"


@query(f"with {HELD_SQL} select q, c, score, '{P.FRAGMENT}' as kind from held")
def lookup_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts and all their sentences that are part of a document line of any length."""
    q = X.with_norm(benchmark_parts(spark, sf_dir), "s", "part").select("s").where("s <> ''").distinct()
    return look.containing(q, normal_lines(spark, sf_dir).select(F.col("stem_norm").alias("s")).distinct())


@query(f"with {HELD_SQL} select p.item_id, arg_min(id, (-score, id)) as id, max(score) as score from held join (select distinct item_id, q from parts) p using (q) group by 1")
def find_top1_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of lookup_contains for each benchmark text."""
    items = X.with_norm(benchmark_parts(spark, sf_dir), "q", "part").select("item_id", "q").distinct()
    lines = normal_lines(spark, sf_dir).select((F.shiftleft(F.col("doc_id"), 20) + F.col("line_no")).alias("id"), F.col("stem_norm").alias("s"))
    # lines of one text have one score, so the first of them comes first, and their texts need not be compared
    best = F.min(F.struct((-F.col("score")).alias("order"), "id")).alias("best")
    hits = look.held_by(items.select(F.col("q").alias("s")).where("s <> ''").distinct(), lines).groupBy("q").agg(best)
    found = hits.select("q", (-F.col("best.order")).alias("score"), "best.id").join(items, "q").groupBy("item_id").agg(best)
    return found.select("item_id", "best.id", (-F.col("best.order")).alias("score"))


@query(f"with {PART_SQL}, n as (select p_partkey, p_brand, p_type, p_size, stem, letter, options, lower(replace(stem, ' ', '')) as c, lower(replace(p_name || ' number ' || p_partkey, ' ', '')) as q from p) select p_partkey as query_id, p_partkey as id, 0.90::double + (0.10::double * length(q)) / length(c) as score, '{P.FRAGMENT}' as kind, '[{P.FRAGMENT} ' || printf('%.2f', 0.90::double + (0.10::double * length(q)) / length(c)) || '] #' || p_partkey || '  ' || stem || chr(10) || '    A. ' || p_brand || chr(10) || '    B. ' || p_type || chr(10) || '    C. size ' || p_size || chr(10) || '    D. none of these' || chr(10) || '  答案: ' || letter || '  → ' || options[ascii(letter) - 64] as shown from n")
def find_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's question found by the end of its stem, as a person reads it. Other stems that hold the query are longer."""
    k = F.col("p_partkey")
    x = letter(k)
    rows = parts(spark, sf_dir).select(k.alias("id"), part_stem().alias("stem_raw"), part_options().alias("options"), x.alias("answer"), X.answer_text(x, part_options()).alias("answer_text"), F.lit(None).cast("string").alias("explanation"))
    stored = normal_once(rows)
    queries = parts(spark, sf_dir).select(k.alias("query_id"), F.concat("p_name", F.lit(" number "), k.cast("string")).alias("query"))
    return look.shown(look.find(queries, stored, 1, 0.95)).select("query_id", "id", "score", "kind", "shown")


def stored_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of a bank: all benchmark texts whole, and the names of all parts; id: (origin, id)."""
    items = table(spark, sf_dir, "benchmark").select(F.struct(F.lit("benchmark").alias("origin"), F.col("item_id").cast("bigint").alias("id")).alias("id"), F.col("text").alias("stem"))
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("stem")).agg(F.struct(F.lit("part").alias("origin"), F.min("p_partkey").cast("bigint").alias("id")).alias("id"))
    return X.with_norm(items.unionByName(names), "stem_norm", "stem")


@query()
def lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored stems, without their second word, looked up among all of them."""
    stored = stored_stems(spark, sf_dir)
    queries = stored.select(F.col("id").alias("query_id"), F.regexp_replace(F.ltrim("stem"), "^(\\S+) \\S+", "$1").alias("query"))
    return look.lookup(queries, stored.select("id", "stem_norm"), top=5, min_score=0.5)


@query(f"with {PART_SQL} select p_partkey as query_id, '答案: ' || {LETTER.format('(4 + ascii(letter) - 65 - p_partkey % 4)')} || '  → ' || options[ascii(letter) - 64] || case when p_partkey % 4 = 0 then '' else '   （题库里存的是 ' || letter || '，说明这次选项顺序不同，已按你看到的顺序重算）' end || chr(10) || '      [完全相同 1.00] ' || stem as text from p")
def resolve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person reads when a pasted question has its options in another order."""
    k = F.col("p_partkey")
    part = parts(spark, sf_dir)
    stored = normal_once(part.select(k.alias("id"), part_stem().alias("stem_raw"), part_options().alias("options"), letter(k).alias("answer")))
    pasted = F.concat(part_stem(), F.lit("\n"), option_lines(turned(part_options(), k % 4)))
    return look.resolved(look.ask(part.select(k.alias("query_id"), pasted.alias("text")), stored))


@query(f"with {PART_SQL} select p_partkey, true as found, {LETTER.format('(4 + ascii(letter) - 65 - p_partkey % 4)')} as letters, options[ascii(letter) - 64] as texts, letter as stored_answer, stem from p")
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = parts(spark, sf_dir)
    stored = normal_once(part.select(k.alias("id"), part_stem().alias("stem_raw"), part_options().alias("options"), letter(k).alias("answer")))
    pasted = F.concat(part_stem(), F.lit("\n"), option_lines(turned(part_options(), k % 4)))
    asked = look.ask(part.select(k.alias("query_id"), pasted.alias("text")), stored)
    return asked.select(F.col("query_id").alias("p_partkey"), "found", "best.letters", F.array_join("best.texts", " / ").alias("texts"), "best.stored_answer", "best.stem")


# --- duplicates


@query()
def dupes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar stems among all stored ones and all sentences of the benchmark."""
    parts = X.with_norm(benchmark_parts(spark, sf_dir).where("part_no > 0"), "stem_norm", "part")
    sentences = parts.groupBy("stem_norm").agg(F.min(F.struct(F.lit("sentence").alias("origin"), (F.col("item_id") * 1000 + F.col("part_no")).cast("bigint").alias("id"))).alias("id"))
    none = F.lit(None).cast("array<string>")
    stems = stored_stems(spark, sf_dir).select("id", "stem_norm").unionByName(sentences.select("id", "stem_norm"))
    found = report.duplicate_pairs(stems.select("id", "stem_norm", none.alias("options"), F.lit("A").alias("answer")), 0.75)
    return found.select(*(F.concat_ws(":", f"{x}_id.origin", F.col(f"{x}_id.id").cast("string")).alias(f"{x}_id") for x in "ab"), "ratio", "length_ratio", "overlap", "answers")


def planted_stems(spark: SparkSession, sf_dir: str, equal: Column) -> DataFrame:
    """A random stem for every part and the same with up to six marks at its end; equal: parts that have one stem instead."""
    k = F.col("p_partkey")
    random = F.base64(F.unhex(F.sha2(k.cast("string"), 256)))
    stem = F.when(equal, "one stem of many questions")
    part = parts(spark, sf_dir)
    plain = part.select((2 * k).alias("id"), F.coalesce(stem, random).alias("stem_norm"), part_options().alias("options"), letter(k).alias("answer"))
    marked = part.where(~equal).select((2 * k + 1).alias("id"), F.concat(random, F.repeat(F.lit("#"), (k % 6 + 1).cast("int"))).alias("stem_norm"), part_options().alias("options"), letter(k + k % 2).alias("answer"))
    return plain.unionByName(marked)


PLANTED_SQL = "planted as (select 2 * p_partkey as a_id, 2 * p_partkey + 1 as b_id, 88::double / (88 + p_partkey % 6 + 1) as ratio, 44::double / (44 + p_partkey % 6 + 1) as length_ratio, 1::double as overlap, case when p_partkey % 2 = 0 then '同' else '异' end as answers from part"


@query(f"with {PLANTED_SQL} where p_partkey >= 3), e as (select 2 * x.p_partkey as a_id, 2 * y.p_partkey as b_id, 1::double as ratio, 1::double as length_ratio, len(list_intersect([x.p_brand, x.p_type, 'size ' || x.p_size, 'none of these'], [y.p_brand, y.p_type, 'size ' || y.p_size, 'none of these']))::double / 4 as overlap, case when x.p_partkey % 4 = y.p_partkey % 4 then '同' else '异' end as answers from part x join part y on x.p_partkey < y.p_partkey and y.p_partkey < 3) select * from (select * from e union all select * from planted) order by ratio desc, a_id, b_id limit 40")
def dupes_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of planted pairs, with ties where the list ends, after a few pairs of equal stems."""
    return report.top_duplicates(planted_stems(spark, sf_dir, F.col("p_partkey") < 3), 0.9, 40)


@query(f"with {PLANTED_SQL}), r as (select 2 * p_partkey as a_id, base64(unhex(sha256(p_partkey::varchar))) as x, repeat('#', cast(p_partkey % 6 + 1 as int)) as m from part) select a_id, b_id, ratio, substr(x || x, 1, {P.STEM_SHOWN}) as a_stem, substr(x || x, 1, {P.TEXT_SHOWN}) as a_text, substr(x || m || x || m, 1, {P.STEM_SHOWN}) as b_stem, substr(x || m || x || m, 1, {P.TEXT_SHOWN}) as b_text from planted join r using (a_id) order by ratio desc, a_id limit 30")
def dupes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of planted pairs with their stems and answers cut to the widths of a list."""
    stems = planted_stems(spark, sf_dir, F.lit(False)).withColumns({c: F.concat("stem_norm", "stem_norm") for c in ("stem_raw", "answer_text")})
    return report.shown_pairs(report.top_duplicates(stems, 0.9, 30), stems).select("a_id", "b_id", "ratio", "a_stem", "a_text", "b_stem", "b_text")


@query(f"with {PLANTED_SQL} where p_partkey % 3 <> 0), n as (select count(*) as n from part where p_partkey % 3 = 0) select ((select count(*) from planted) + n * (n - 1) // 2)::bigint as pairs from n")
def dupes_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a bank where a third of all questions has one stem."""
    return report.duplicate_count(planted_stems(spark, sf_dir, F.col("p_partkey") % 3 == 0), 0.9)


@query(f"with {PART_SQL}, n as (select p_partkey as a_id, options as a, lead(p_partkey) over w as b_id, lead(options) over w as b from p window w as (partition by p_name order by p_partkey)) select a_id, b_id, len(list_intersect(a, b))::double / greatest(len(list_distinct(a)), len(list_distinct(b))) as overlap from n where b_id is not null")
def option_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = Window.partitionBy("p_name").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", part_options().alias("o"))
    pairs = rows.select(F.col("p_partkey").alias("a_id"), F.lead("p_partkey").over(by_name).alias("b_id"), F.col("o").alias("a"), F.lead("o").over(by_name).alias("b"))
    return pairs.where("b_id is not null").select("a_id", "b_id", report.option_overlap(F.col("a"), F.col("b")).alias("overlap"))


# --- maintenance and practice


@query("with s as (select p_mfgr as source, count(*) as n from (select case when p_partkey % 100 < 92 then 'script' else p_brand end as p_mfgr from part) group by 1) select source, n as matched, (select count(*) from part) as total, case when n >= 0.9 * (select count(*) from part) then 'refuse' else 'delete' end as decision from s")
def clear_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("p_partkey") % 100 < 92, "script").otherwise(F.col("p_brand"))
    return maintenance.clear_plans(table(spark, sf_dir, "part").select(source.alias("source")))


@query("select p_partkey as id, p_name as stem_raw from part where p_name ilike '%AL%' or lower(replace(p_name, ' ', '')) like '%al%'")
def forget_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("stem_raw"), X.norm("p_name").alias("stem_norm"))
    return maintenance.forget_matches(stored, fragment="AL").select("id", "stem_raw")


@query("select user_id as id, count_if(event_type = 'error')::bigint as wrong_count, count_if(event_type <> 'error')::bigint as right_count from events group by 1 order by 2 desc, 3, 1 limit 20")
def quiz_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stem_key"), (F.col("event_type") != "error").alias("ok"))
    stored = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("user_id").cast("string").alias("stem_key")).distinct()
    return report.practice(report.with_attempts(stored, events), 20, None).select("id", "wrong_count", "right_count")


@query(f"with {PART_SQL} select p_partkey as id, u.i as variant, case u.i when 0 then true when 1 then true when 2 then letter = 'A' end as ok from p, unnest([0, 1, 2]) as u(i)")
def grade_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    x = letter(F.col("p_partkey"))
    given = F.array(F.concat(F.lit("（"), F.lower(x), F.lit("）")), F.concat(x, F.lit("、")), F.lit("A"), F.lit("  "))
    answers = part.select(F.col("p_partkey").alias("id"), F.posexplode(given).alias("variant", "given")).select((F.col("id") * 4 + F.col("variant")).alias("attempt_id"), "id", "given")
    stored = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("stem_key"), x.alias("answer"))
    return report.grade(answers, stored).select("id", (F.col("attempt_id") % 4).cast("int").alias("variant"), "ok")


@query(f"with {PART_SQL}, g as (select p_partkey % 10 as session, u.i = 0 or u.i = 1 or letter = 'A' as ok from p, unnest([0, 1, 2]) as u(i)), c as (select session, count_if(ok)::bigint as right, count_if(not ok)::bigint as wrong from g group by 1) select *, '本轮 对 ' || right || ' / 错 ' || wrong as text from c".replace(" as right", ' as "right"').replace("|| right ||", '|| "right" ||'))
def session_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong answers of ten sessions."""
    return report.session_score(grade_attempts(spark, sf_dir).withColumn("session", F.col("id") % 10), "session")
