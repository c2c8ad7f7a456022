"""The fold of captures into questions and conflicts.

Captures of a question are taken in order: the first one with an answer inserts it, one with the same answer replaces the stored
letters and options (an update), another one is logged (a conflict). Answers are the same if their letters are, or if the texts
of the options that they name are. The state is (answer, options), so the order matters; yet no group is ever gathered whole:

- captures of a question are cut into chunks of bounded size, folded in parallel, each from an assumed state;
- a chunk's assumption is checked against the end of the chunk before, over the small table of chunks, and only the chunks
  that assumed wrongly are folded again, until none did. Answers rarely change, so the first guess, the question's first
  capture, is nearly always right;
- questions whose captures all have the same answer need no fold: plain aggregates tell their state.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions import patterns as P
from stemforge.functions import text as X
from stemforge.sources.tables import Workspace

#: Captures of one question in a chunk: so many on average, twice as many at most.
CHUNK = 500
#: Ranges of a batch within which questions are numbered.
RANGES = 4096
CAPTURED = ("batch_id", "seq", "source", "stem", "options", "answer", "qtype", "explanation", "seen_at")
STATE = "struct<answer:string,options:array<string>,text:string>"
CHUNK_KEY = ["fold_key", "batch_id", "part"]


def prepared(captures: DataFrame, wide: bool = True, *also: str) -> DataFrame:
    """captures (batch_id, seq, source, stem, options, answer, qtype, explanation, seen_at) with clean stem and answer, stem_norm,
    stem_key and answer_text; kept false for those without a stem or an answer, which a fold skips. (batch_id, seq) is the order
    and must be unique. Null options count as none. wide false: stem_key or answer are null, without Python, where NFKC is needed.
    also: further columns that stay."""
    c = captures.select(*also, "batch_id", "seq", "source", X.clean_stem("stem").alias("stem"), F.coalesce("options", F.array().cast("array<string>")).alias("options"), X.norm_answer("answer", wide).alias("answer"), F.coalesce(F.nullif("qtype", F.lit("")), F.lit("single")).alias("qtype"), F.nullif("explanation", F.lit("")).alias("explanation"), "seen_at")
    c = X.with_norm(c, "stem_norm", "stem", wide).withColumn("kept", (F.col("stem") != "") & (F.col("answer") != ""))
    generic = X.is_generic(F.col("stem_norm"))
    c = c.withColumn("stem_key", X.stem_key(F.col("stem_norm"), X.norm_array(F.when(generic, F.col("options")), wide)))
    return c.withColumn("answer_text", F.when(F.size("options") > 0, X.answer_text(F.col("answer"), F.col("options"))))


def prepared_table(captures: DataFrame, space: Workspace) -> DataFrame:
    """prepared as a table. Only rows with a text that Python must see go there; if there is none, no Python worker is started."""
    raw = F.struct(*[f.name for f in captures.schema if f.name in CAPTURED])
    rows = prepared(captures.withColumn("raw", raw), False, "raw")
    odd = F.col("stem_key").isNull() | F.col("answer").isNull()
    done = space.table(rows.withColumn("raw", F.when(odd, F.col("raw"))), "native")
    left, done = done.where("raw is not null").select("raw.*"), done.where("raw is null").drop("raw")
    return done if left.isEmpty() else done.unionByName(space.table(prepared(left), "wide"))


def same_answer(state: Column, x: Column, strict: bool = False) -> Column:
    """Whether the letters are equal or the texts that they name. strict: by the texts in any order where both are known, so that equal
    letters of other texts differ, and several texts in another order do not."""
    letters = state["answer"] == x["answer"]
    if strict:
        texts = lambda t: F.array_sort(F.split(t, P.ANSWER_JOIN))
        return F.when(state["text"].isNotNull() & x["answer_text"].isNotNull(), texts(state["text"]) == texts(x["answer_text"])).otherwise(letters)
    stored = F.when(F.size(state["options"]) > 0, X.answer_text(state["answer"], state["options"]))
    return letters | F.coalesce(stored == x["answer_text"], F.lit(False))


def _accepted(x: Column, options: Column) -> Column:
    return F.struct(x["answer"].alias("answer"), options.alias("options"), x["answer_text"].alias("text")).cast(STATE)


def fold_chunk(rows: Column, assumed: Column, strict: bool = False) -> Column:
    """(state, outcomes) of a chunk's sorted rows from an assumed state, null before a question's first capture."""
    start = F.struct(assumed.cast(STATE).alias("state"), F.array().cast("array<struct<seq:bigint,outcome:string,old_answer:string>>").alias("outcomes"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["state"]
        same = same_answer(s, x, strict)
        state = F.when(s.isNull(), _accepted(x, x["options"])).when(same, _accepted(x, F.when(F.size(x["options"]) > 0, x["options"]).otherwise(s["options"]))).otherwise(s)
        outcome = F.when(s.isNull(), "insert").when(same, "update").otherwise("conflict")
        entry = F.struct(x["seq"].cast("bigint").alias("seq"), outcome.alias("outcome"), s["answer"].alias("old_answer"))
        return F.struct(state.cast(STATE).alias("state"), F.concat(acc["outcomes"], F.array(entry)).alias("outcomes"))

    return F.aggregate(rows, start, step)


def with_epochs(captures: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    """captures with fold_key, which a tombstone of the key changes for later batches, and live: no later tombstone hides them."""
    if tombstones is None:
        return captures.withColumn("fold_key", F.col("stem_key")).withColumn("live", F.lit(True))
    marks = tombstones.groupBy("stem_key").agg(F.collect_set("batch_id").alias("marks"))
    both = captures.join(marks, "stem_key", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<bigint>")))
    epoch = F.size(F.filter("marks", lambda t: t < F.col("batch_id")))
    return both.withColumn("fold_key", F.concat_ws("#", "stem_key", epoch)).withColumn("live", epoch == F.size("marks")).drop("marks")


def chunked(kept: DataFrame) -> DataFrame:
    """kept with part: (range, piece) of a capture among those of its question and batch, in order. A question with few captures in a
    batch is one chunk; the others' sequence numbers are cut into as many ranges as give CHUNK captures on average, and a
    range that still has twice as many into pieces of CHUNK numbers."""
    owner = ["fold_key", "batch_id"]
    many = kept.groupBy(*owner).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).where(F.col("n") > CHUNK)
    width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / CHUNK))).cast("bigint")
    ranged = kept.join(many.select(*owner, "low", width.alias("width")), owner, "left")
    ranged = ranged.withColumn("range", F.coalesce(F.floor((F.col("seq") - F.col("low")) / F.col("width")), F.lit(0)).cast("bigint"))
    crowded = ranged.where("width is not null").groupBy(*owner, "range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CHUNK).select(*owner, "range", F.lit(True).alias("crowded"))
    piece = F.when(F.col("crowded"), F.floor(F.col("seq") / CHUNK)).otherwise(0).cast("bigint")
    return ranged.join(crowded, [*owner, "range"], "left").withColumn("part", F.struct("range", piece.alias("piece"))).drop("low", "width", "range", "crowded")


def folded_chunks(kept: DataFrame, space: Workspace, strict: bool = False, start: DataFrame | None = None) -> DataFrame:
    """fold_key, batch_id, part, state (at the chunk's end) and outcomes. start: (fold_key, state) that questions are in before."""
    fields = F.struct(F.col("seq"), F.col("answer"), F.col("options"), F.col("answer_text"))
    chunks = chunked(kept).groupBy(*CHUNK_KEY).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    start = kept.select("fold_key").limit(0).withColumn("state", F.lit(None).cast(STATE)) if start is None else start
    known = start.select("fold_key", F.col("state").cast(STATE).alias("start"))
    order = Window.partitionBy("fold_key").orderBy("batch_id", "part")
    chunks = space.table(chunks.join(known, "fold_key", "left"), "chunks")
    later = space.table(chunks.select(*CHUNK_KEY, F.lag("batch_id").over(order).isNotNull().alias("later")).where("later").select(*CHUNK_KEY), "later")
    if later.isEmpty():
        return _run(chunks.withColumn("assumed", F.col("start")), strict).select(*CHUNK_KEY, "state", "outcomes")
    first = kept.groupBy("fold_key").agg(F.min(F.struct("batch_id", "seq", "answer", "options", "answer_text")).alias("x"))
    guess = first.select("fold_key", F.struct(F.col("x.answer").alias("answer"), F.col("x.options").alias("options"), F.col("x.answer_text").alias("text")).cast(STATE).alias("guess"))
    guesses = later.join(guess, "fold_key")
    assumed = F.coalesce("start", "guess")
    rounds = [space.table(_run(chunks.join(guesses, CHUNK_KEY, "left").withColumn("assumed", assumed), strict).withColumn("round", F.lit(0)), "folded")]
    small = [*CHUNK_KEY, "start", "assumed", "state"]
    states = rounds[0].select(small)
    while True:
        before = states.withColumn("actual", F.when(F.lag("batch_id").over(order).isNull(), F.col("start")).otherwise(F.lag("state").over(order)))
        wrong = before.where(~F.col("actual").eqNullSafe(F.col("assumed"))).select(*CHUNK_KEY, F.col("actual").alias("assumed"))
        wrong = space.table(wrong, "wrong")
        if wrong.isEmpty():
            break
        rounds.append(space.table(_run(chunks.join(wrong, CHUNK_KEY), strict).withColumn("round", F.lit(len(rounds))), "folded"))
        states = space.table(states.join(wrong.select(*CHUNK_KEY), CHUNK_KEY, "left_anti").unionByName(rounds[-1].select(small)), "states")
    if len(rounds) == 1:
        return rounds[0].select(*CHUNK_KEY, "state", "outcomes")
    # of a chunk that was folded again the last round counts; only such chunks are read again to tell
    again = functools.reduce(DataFrame.unionByName, rounds[1:])
    last = again.groupBy(*CHUNK_KEY).agg(F.max("round").alias("round"))
    once = rounds[0].join(last.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")
    return once.unionByName(again.join(last, [*CHUNK_KEY, "round"]), allowMissingColumns=True).select(*CHUNK_KEY, "state", "outcomes")


def _run(todo: DataFrame, strict: bool) -> DataFrame:
    done = todo.withColumn("fold", fold_chunk(F.col("rows"), F.col("assumed"), strict))
    return done.select(*CHUNK_KEY, "start", "assumed", "fold.state", "fold.outcomes")


class Fold:
    """The outcome of folding captures: questions, conflicts, outcomes (one row per capture), tally and repeats per batch.

    tombstones (stem_key, batch_id) end a question's life: captures of later batches insert it anew. Conflicts outlive it.
    strict: see same_answer. start: (stem_key, state) of questions that were there before, from which their captures go on; captures with
    stem_norm are taken as prepared.
    """

    def __init__(self, captures: DataFrame, tombstones: DataFrame | None = None, space: Workspace | None = None, strict: bool = False, start: DataFrame | None = None):
        self.space, self.strict = space or Workspace(captures.sparkSession), strict
        ready = captures if "stem_norm" in captures.columns else prepared_table(captures, self.space)
        known = with_epochs(ready, tombstones)
        self.captures = known if tombstones is None else self.space.table(known, "captures")
        self.kept = self.captures.where("kept")
        self.start = None if start is None else start.select(F.col("stem_key").alias("fold_key"), "state")

    @functools.cached_property
    def chunks(self) -> DataFrame:
        """The folded chunks of all questions."""
        return self.space.table(folded_chunks(self.kept, self.space, self.strict, self.start), "chunk_states")

    @functools.cached_property
    def contested(self) -> DataFrame | None:
        """The folded chunks of questions with different answers (strict: or texts of them), null if there are none. Of the others every capture
        but the first is an update, whatever the order. Answers are told apart by two hashes of 64 bits."""
        rows = self.kept.select("fold_key", "answer", F.col("answer_text").alias("text"))
        if self.start is not None:
            rows = rows.unionByName(self.start.select("fold_key", "state.answer", "state.text"))
        what = ["answer", F.coalesce("text", F.lit("")), F.col("text").isNull()] if self.strict else ["answer"]
        hashes = rows.select("fold_key", *(F.xxhash64(F.lit(i), *what).alias(f"h{i}") for i in range(2)))
        ends = hashes.groupBy("fold_key").agg(*(f(f"h{i}").alias(f"{f.__name__}{i}") for i in range(2) for f in (F.min, F.max)))
        keys = self.space.table(ends.where("min0 <> max0 or min1 <> max1").select("fold_key"), "contested")
        if keys.isEmpty():
            return None
        start = self.start if self.start is None else self.start.join(keys, "fold_key", "left_semi")
        return self.space.table(folded_chunks(self.kept.join(keys, "fold_key", "left_semi"), self.space, self.strict, start), "chunk_states")

    def _contested_outcomes(self) -> DataFrame:
        if self.contested is None:
            none = F.lit(None).cast("string")
            return self.kept.where(F.lit(False)).select("batch_id", F.col("seq").cast("bigint").alias("seq"), "stem_key", none.alias("outcome"), none.alias("old_answer"))
        return self.contested.select("fold_key", "batch_id", F.explode("outcomes").alias("o")).select("batch_id", "o.seq", F.substring("fold_key", 1, 40).alias("stem_key"), "o.outcome", "o.old_answer")

    @property
    def outcomes(self) -> DataFrame:
        """batch_id, seq, stem_key, outcome (insert, update, conflict or skip) and old_answer of every capture."""
        settled = self.kept if self.contested is None else self.kept.join(self.contested.select("fold_key").distinct(), "fold_key", "left_anti")
        firsts = settled.groupBy("fold_key").agg(F.min(F.struct("batch_id", "seq")).alias("first"))
        if self.start is not None:
            firsts = firsts.join(self.start.select("fold_key"), "fold_key", "left_anti")
        new = F.coalesce(F.struct("batch_id", "seq") == F.col("first"), F.lit(False))
        done = settled.join(firsts, "fold_key", "left").select("batch_id", F.col("seq").cast("bigint").alias("seq"), "stem_key", F.when(new, "insert").otherwise("update").alias("outcome"), F.when(~new, F.col("answer")).alias("old_answer"))
        skipped = self.captures.where("not kept").select("batch_id", F.col("seq").cast("bigint").alias("seq"), "stem_key", F.lit("skip").alias("outcome"), F.lit(None).cast("string").alias("old_answer"))
        return done.unionByName(self._contested_outcomes()).unionByName(skipped)

    @property
    def conflicts(self) -> DataFrame:
        """stem_key, stem_raw (the new capture's), old_answer, new_answer, source, seen_at, batch_id and seq of contradicting captures."""
        found = self._contested_outcomes().where("outcome = 'conflict'").select("batch_id", "seq", "old_answer")
        rows = self.kept.join(found, ["batch_id", "seq"])
        return rows.select("stem_key", F.col("stem").alias("stem_raw"), "old_answer", F.col("answer").alias("new_answer"), "source", "seen_at", "batch_id", "seq")

    @property
    def questions(self) -> DataFrame:
        """One row per stem_key. first_batch and first_seq order the questions as they were inserted."""
        order = ["batch_id", "seq"]
        first = F.min(F.struct(*order, "stem", "stem_norm", "qtype", "explanation", "source", "seen_at"))
        last = F.max(F.struct(*order, "seen_at", "answer", F.col("answer_text").alias("text")))
        given = F.max(F.when(F.size("options") > 0, F.struct(*order, "options")))
        rows = self.kept.where("live").groupBy("fold_key", "stem_key").agg(first.alias("f"), last.alias("l"), F.count(F.lit(1)).alias("times_seen"), given.alias("given"))
        options = F.col("given.options")
        if self.start is not None:
            rows = rows.join(self.start.select("fold_key", F.col("state.options").alias("before")), "fold_key", "left")
            options = F.coalesce(options, "before")
        state = F.struct(F.col("l.answer").alias("answer"), options.alias("options"), F.col("l.text").alias("text")).cast(STATE)
        if self.contested is not None:
            ends = self.contested.groupBy("fold_key").agg(F.max_by("state", F.struct("batch_id", "part")).alias("folded"))
            rows, state = rows.join(ends, "fold_key", "left"), F.coalesce("folded", state)
        options = F.when(F.size("state.options") > 0, F.col("state.options"))
        return rows.withColumn("state", state).select(
            "stem_key", F.col("f.stem").alias("stem_raw"), "f.stem_norm", "f.qtype", options.alias("options"), F.col("state.answer").alias("answer"), F.col("state.text").alias("answer_text"),
            "f.explanation", "f.source", F.col("f.seen_at").alias("first_seen"), F.col("l.seen_at").alias("last_seen"), "times_seen", F.col("f.batch_id").alias("first_batch"), F.col("f.seq").alias("first_seq"),
        )

    @property
    def tally(self) -> DataFrame:
        """Captures by batch_id and outcome, a column each, 0 where there are none."""
        return self.outcomes.groupBy("batch_id").pivot("outcome", ["insert", "update", "skip", "conflict"]).count().na.fill(0)

    @property
    def repeats(self) -> DataFrame:
        """Captures with a stem whose key the batch had before (within), or else an earlier batch had with an answer (across)."""
        rows = self.captures.where("stem <> ''")
        first = rows.groupBy("batch_id", "stem_key").agg(F.min("seq").alias("first_seq"))
        stored = self.kept.select("fold_key", "batch_id")
        if self.start is not None:
            stored = stored.unionByName(self.start.select("fold_key", F.lit(-1).cast("bigint").alias("batch_id")))
        stored = stored.groupBy("fold_key").agg(F.min("batch_id").alias("stored_in"))
        both = rows.select("batch_id", "seq", "stem_key", "fold_key", "stem").join(first, ["batch_id", "stem_key"]).join(stored, "fold_key", "left")
        kind = F.when(F.col("seq") > F.col("first_seq"), "within").when(F.col("stored_in") < F.col("batch_id"), "across")
        return both.select("batch_id", "seq", "stem_key", "stem", kind.alias("kind")).where("kind is not null")


def numbered(questions: DataFrame, space: Workspace | None = None) -> DataFrame:
    """questions with dense ids from 1 in the order of their first capture, without sorting a batch in one task: rows are numbered within
    RANGES ranges of their batch's sequence numbers, and the ranges' counts, few rows, give where each begins."""
    rows = (space or Workspace(questions.sparkSession)).table(questions, "unnumbered")
    spans = rows.groupBy("first_batch").agg(F.min("first_seq").alias("low"), F.ceil((F.max("first_seq") - F.min("first_seq") + 1) / RANGES).alias("width"), F.count(F.lit(1)).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    batches = spans.withColumn("start", earlier(Window.orderBy("first_batch"))).drop("n")
    ranged = rows.join(batches, "first_batch").withColumn("range", F.floor((F.col("first_seq") - F.col("low")) / F.col("width"))).drop("low", "width")
    counts = ranged.groupBy("first_batch", "range").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.withColumn("before", earlier(Window.partitionBy("first_batch").orderBy("range"))).drop("n")
    place = F.row_number().over(Window.partitionBy("first_batch", "range").orderBy("first_seq"))
    found = ranged.join(begins, ["first_batch", "range"])
    return found.withColumn("id", (F.col("start") + F.col("before") + place).cast("bigint")).select("id", *questions.columns)
