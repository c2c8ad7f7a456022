"""Reports and practice: near-duplicate questions, statistics, practice lists and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions import patterns as P
from stemforge.functions import text as X
from stemforge.operators import similarity as S
from stemforge.sources.tables import Workspace

SAME, OTHER = "同", "异"
LEAST_LENGTH_RATIO = 0.6


def option_overlap(a: Column, b: Column) -> Column:
    """Options that two questions share, of those of the one with more (as sets); null if either has none."""
    largest = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / largest)


#: Ratios at which a search for the most similar pairs looks whether it has enough, the highest first.
LEVELS = (0.95, 0.9, 0.85, 0.8)
#: Ranges of ids in which pairs of two groups are counted.
RANGES = 4096


def _questions(questions: DataFrame, space: Workspace) -> DataFrame:
    return space.table(questions.select("id", "stem_norm", "options", "answer").where("stem_norm <> ''"), "questions")


def similar_stems(q: DataFrame, min_ratio: float, space: Workspace) -> DataFrame:
    """(a, b, ratio) of different stems, in the order that the ratio is for: either order of two stems may reach min_ratio, or both."""
    stems = space.table(q.select("stem_norm").distinct().select(F.monotonically_increasing_id().alias("id"), F.col("stem_norm").alias("s")), "stems")
    space.release()
    found = S.ratio_candidates(stems, stems, min_ratio, space).where("a_id < b_id")
    text = lambda x: stems.select(F.col("id").alias(f"{x}_id"), F.col("s").alias(x))
    wide = found.join(text("a"), "a_id").join(text("b"), "b_id").select("a", "b").where(length_ratio() >= LEAST_LENGTH_RATIO)
    both = space.table(wide.select("a", "b", S.ratio("a", "b").alias("ab"), S.ratio("b", "a").alias("ba")).where(F.greatest("ab", "ba") >= min_ratio), "similar")
    space.release()
    return both.select("a", "b", F.col("ab").alias("ratio")).union(both.select("b", "a", "ba")).where(F.col("ratio") >= min_ratio)


def length_ratio() -> Column:
    return F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))


def _compared(pairs: DataFrame) -> DataFrame:
    """Rows of pairs (a, b, ratio, and id, options and answer of both) as duplicate_pairs gives them."""
    answers = F.when(X.norm_answer("a_answer") == X.norm_answer("b_answer"), SAME).otherwise(OTHER)
    return pairs.select("a_id", "b_id", "ratio", length_ratio().alias("length_ratio"), option_overlap(F.col("a_options"), F.col("b_options")).alias("overlap"), answers.alias("answers"))


def _side(q: DataFrame, x: str) -> DataFrame:
    return q.select(*(F.col(c).alias(f"{x}_{c}") for c in ("id", "options", "answer")), F.col("stem_norm").alias(x))


def duplicate_pairs(questions: DataFrame, min_ratio: float = 0.75, space: Workspace | None = None) -> DataFrame:
    """a_id < b_id, ratio, length_ratio, overlap (of options), answers (同 or 异) of every pair of questions with similar stems.

    The ratio is that of the normal stems in the order of the ids. Questions with the same stem have the ratio 1 and are paired by an
    equi-join; other pairs are found between distinct stems. Empty stems are paired with nothing. All pairs of a stem that many questions
    have are rows here: top_duplicates and duplicate_count don't make them.
    """
    space = space or Workspace(questions.sparkSession)
    q = _questions(questions, space)
    equal = q.select(F.col("stem_norm").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("ratio"))
    pairs = similar_stems(q, min_ratio, space).unionByName(equal)
    return _compared(pairs.join(_side(q, "a"), "a").join(_side(q, "b"), "b").where("a_id < b_id"))


def _first_equal(q: DataFrame, top: int) -> DataFrame:
    """(a, b, ratio, a_id, b_id) of the first pairs of questions with the same stem, by ids. A pair's first question is among the top first
    ones that a question of the same stem follows; only their stems' questions are looked at again, top times at most."""
    last = q.groupBy("stem_norm").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("stem_norm", "last")
    firsts = q.select("id", "stem_norm").join(last, "stem_norm").where("id < last").orderBy("id").limit(top).select(F.col("id").alias("a_id"), "stem_norm")
    pairs = q.select(F.col("id").alias("b_id"), "stem_norm").join(F.broadcast(firsts), "stem_norm").where("a_id < b_id")  # top rows
    return pairs.orderBy("a_id", "b_id").limit(top).select(F.col("stem_norm").alias("a"), F.col("stem_norm").alias("b"), F.lit(1.0).alias("ratio"), "a_id", "b_id")


def _first_similar(q: DataFrame, similar: DataFrame, top: int, space: Workspace) -> DataFrame:
    """(a, b, ratio, a_id, b_id) of the first pairs of questions whose stems are similar (a, b, ratio), by ratio and ids.

    Of two stems' questions only the top first of one, and of the other the top first behind the least of these, can be in the first
    top pairs; ranks of that kind are cut before the shuffle, so stems that many questions have don't multiply.
    """
    ranked = lambda rows, keys, by: rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where(F.col("_rank") <= top).drop("_rank")
    ids = q.select("id", "stem_norm")
    first = space.table(ranked(ids.join(similar.select(F.col("a").alias("stem_norm")).distinct(), "stem_norm"), ["stem_norm"], "id"), "first")
    least = first.groupBy(F.col("stem_norm").alias("a")).agg(F.min("id").alias("least"))
    behind = similar.join(least, "a").join(ids.select(F.col("stem_norm").alias("b"), F.col("id").alias("b_id")), "b").where("b_id > least")
    behind = ranked(behind.select("a", "b", "ratio", "b_id"), ["a", "b"], "b_id")
    pairs = behind.join(first.select(F.col("stem_norm").alias("a"), F.col("id").alias("a_id")), "a").where("a_id < b_id")
    return pairs.orderBy(F.desc("ratio"), "a_id", "b_id").limit(top).select("a", "b", "ratio", "a_id", "b_id")


def top_duplicates(questions: DataFrame, min_ratio: float = 0.75, top: int = 20, space: Workspace | None = None) -> DataFrame:
    """The duplicate pairs of the highest ratio, then the lowest ids; as duplicate_pairs, without making all others.

    Equal stems come first. If they are too few, similar stems are searched at a high ratio, which few pairs can reach, then at lower
    ones, until as many pairs are found as are asked for: what is below can't be among them.
    """
    space = space or Workspace(questions.sparkSession)
    q = _questions(questions, space)
    found = space.table(_first_equal(q, top), "equal")
    missing = top - found.count()
    for level in [x for x in LEVELS if x > min_ratio] + [min_ratio] if missing else []:
        more = space.table(_first_similar(q, space.table(similar_stems(q, level, space), "levels"), missing, space), "more")
        space.release()
        if level == min_ratio or more.count() == missing:
            found = found.unionByName(more)
            break
    ids = space.table(found.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct(), "ids")  # twice top rows
    facts = q.drop("stem_norm").join(F.broadcast(ids), "id")
    side = lambda x: facts.select(*(F.col(c).alias(f"{x}_{c}") for c in ("id", "options", "answer")))
    return _compared(found.join(side("a"), "a_id").join(side("b"), "b_id")).orderBy(F.desc("ratio"), "a_id", "b_id")


def duplicate_count(questions: DataFrame, min_ratio: float = 0.75, space: Workspace | None = None) -> DataFrame:
    """One row: pairs, how many rows duplicate_pairs would have, from the counts of questions by stem. ids: numbers.

    Two similar stems count all pairs of their questions if the ratio is reached in either order; if only in one, those whose ids are in
    that order, which are counted by ranges of ids.
    """
    space = space or Workspace(questions.sparkSession)
    q = _questions(questions, space)
    sizes = space.table(q.groupBy("stem_norm").agg(F.count(F.lit(1)).alias("n")), "sizes")
    size = lambda x: sizes.select(F.col("stem_norm").alias(x), F.col("n").alias(f"{x}_n"))
    similar = similar_stems(q, min_ratio, space).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b")
    grouped = space.table(similar.groupBy("x", "y").agg(F.count(F.lit(1)).alias("orders"), F.first("a").alias("a"), F.first("b").alias("b")), "orders")
    equal = sizes.select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    either = grouped.where("orders = 2").select("a", "b").join(size("a"), "a").join(size("b"), "b").select((F.col("a_n") * F.col("b_n")).alias("pairs"))
    total = equal.unionByName(either).unionByName(_ordered_pairs(q, grouped.where("orders = 1").select("a", "b"), space))
    return total.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("pairs"))


def _ordered_pairs(q: DataFrame, stems: DataFrame, space: Workspace) -> DataFrame:
    """pairs: for parts of the stems (a, b), pairs of a question of a and one of b behind it, by ids; they add up to all."""
    span = q.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    width = max(1, ((span["high"] or 0) - (span["low"] or 0)) // RANGES + 1)
    ids = q.select("stem_norm", "id", F.floor((F.col("id") - F.lit(span["low"] or 0)) / width).alias("range"))
    side = lambda x, first: stems.join(ids.withColumnRenamed("stem_norm", x), x).select("a", "b", "range", "id", F.lit(first).alias("first"))
    rows = space.table(side("a", 1).unionByName(side("b", 0)), "ordered")
    counts = rows.groupBy("a", "b", "range").agg(F.sum("first").alias("firsts"), F.sum(1 - F.col("first")).alias("seconds"))
    before = F.coalesce(F.sum("firsts").over(Window.partitionBy("a", "b").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    across = counts.select((F.col("seconds") * before).cast("bigint").alias("pairs"))
    within = F.sum("first").over(Window.partitionBy("a", "b", "range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.select("first", within.alias("earlier")).where("first = 0").select(F.coalesce("earlier", F.lit(0)).cast("bigint").alias("pairs"))
    return across.unionByName(inside)


def stats(questions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row: questions, sightings, once, hot (three times or more), shaky (ever wrong), bad (wrong and never right), conflicts."""
    count = lambda c: F.count_if(c).alias
    seen, wrong, right = F.col("times_seen"), F.col("wrong_count"), F.col("right_count")
    row = questions.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum(seen), F.lit(0)).alias("sightings"), count(seen == 1)("once"), count(seen >= 3)("hot"), count(wrong > 0)("shaky"), count((wrong > 0) & (right == 0))("bad"))
    return row.join(F.broadcast(conflicts.agg(F.count(F.lit(1)).alias("conflicts"))))  # one row each


def by_source(questions: DataFrame, top: int | None = 10) -> DataFrame:
    """Questions by source, most first, then by source; top of them, or all if null."""
    counts = questions.groupBy("source").agg(F.count(F.lit(1)).alias("questions")).orderBy(F.desc("questions"), F.asc_nulls_first("source"))
    return counts if top is None else counts.limit(top)


def with_attempts(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """questions with right_count and wrong_count from the log of attempts (stem_key, ok)."""
    counts = attempts.groupBy("stem_key").agg(F.count_if("ok").alias("right_count"), F.count_if(~F.col("ok")).alias("wrong_count"))
    zero = F.lit(0).cast("bigint")
    rows = questions.drop("right_count", "wrong_count").join(counts, "stem_key", "left")
    return rows.withColumn("right_count", F.coalesce("right_count", zero)).withColumn("wrong_count", F.coalesce("wrong_count", zero))


def practice(questions: DataFrame, n: int = 20, seed: int | None = 0) -> DataFrame:
    """The n questions that are most often wrong, then least often right, then in an order that depends on the seed (null: by id)."""
    tie = F.lit(0).cast("bigint") if seed is None else F.xxhash64("id", F.lit(seed))
    return questions.orderBy(F.desc("wrong_count"), "right_count", tie, "id").limit(n)


def grade(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers (attempt_id, id, given) with ok: whether the given answer's normal form is the stored one's. Blank answers are passed over."""
    given = answers.where(X.strip(F.coalesce("given", F.lit(""))) != "")
    both = given.join(questions.select("id", "stem_key", "answer"), "id")
    return both.select("attempt_id", "id", "stem_key", "given", (X.norm_answer(X.strip(F.col("given"))) == X.norm_answer("answer")).alias("ok"))


def session_score(graded: DataFrame, session: str | None = None) -> DataFrame:
    """Right and wrong answers of graded rows (ok), and the line that says so, for each value of the column session or over all."""
    keys = [session] if session else []
    counts = graded.groupBy(*keys).agg(F.count_if("ok").alias("right"), F.count_if(~F.col("ok")).alias("wrong"))
    before, between = P.SESSION.split("{}")[:2]
    return counts.withColumn("text", F.concat(F.lit(before), F.col("right").cast("string"), F.lit(between), F.col("wrong").cast("string")))


def shown_pairs(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """pairs (of duplicate_pairs) with the stems and answer texts of both questions, cut to the widths of a list."""

    def side(x: str) -> DataFrame:
        return questions.select(F.col("id").alias(f"{x}_id"), F.substring("stem_raw", 1, P.STEM_SHOWN).alias(f"{x}_stem"), F.substring("answer_text", 1, P.TEXT_SHOWN).alias(f"{x}_text"))

    return pairs.join(side("a"), "a_id").join(side("b"), "b_id")
