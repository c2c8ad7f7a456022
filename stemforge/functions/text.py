"""Normal forms of stems, options and answers, and the identity of a question, as column expressions.

Everything runs in the JVM, Unicode's NFKC too where it works character by character and gives one for one: in Latin, Chinese and Japanese
text, full-width forms and punctuation (BLOCKS). An Arrow function gets only the strings that have another character (others are
null to it), where characters combine or come apart.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.functions import patterns as P

#: First and last code points of what is normalised in the JVM, by the rule of _one_for_one.
BLOCKS = ((0x00, 0x7F), (0xA0, 0xFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3000, 0x3029), (0x3030, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FE), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF9D))
DROPPED = r"[\p{P}\p{Z}]"
STRIP = f"(?U)^{P.WS}+|{P.WS}+$"
HAS_WHITE, NOT_WHITE = f"(?U){P.WS}", r"(?U)[^\s\x1C-\x1F]"
SHORT_STEM, SHORT_REST = 8, 6


def _one_for_one(ch: str, dropped: bool) -> bool:
    """Whether NFKC takes a character alone and gives one for it; dropped: or gives such as are dropped, as the character itself is."""
    form = unicodedata.normalize("NFKC", ch)
    alone = not any(unicodedata.combining(x) or unicodedata.category(x)[0] == "M" for x in (ch, *unicodedata.normalize("NFKD", ch)[:1], *form))
    gone = dropped and all(unicodedata.category(x)[0] in "PZ" for x in (ch, *form))
    return alone and (len(form) == 1 or gone)


@functools.cache
def _plain_pattern(dropped: bool) -> str:
    """A pattern of strings whose characters are all one for one."""
    ranges: list[list[int]] = []
    for first, last in BLOCKS:
        for c in range(first, last + 1):
            if _one_for_one(chr(c), dropped):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
    # runs of ASCII first: one range to look at for most characters, in place of all
    return r"(?s)^(?:[\x00-\x7F]++|[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + r"]++)*+\z"


@functools.cache
def _forms() -> tuple[str, str]:
    """The characters of BLOCKS that NFKC replaces by another one, and these."""
    found = [(chr(c), form) for first, last in BLOCKS for c in range(first, last + 1) if _one_for_one(chr(c), False) and (form := unicodedata.normalize("NFKC", chr(c))) != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """A string without white space at its ends; only strings that have some there are searched."""
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return bound(c, lambda x: F.when(ends(x).rlike(HAS_WHITE), F.regexp_replace(x, STRIP, "")).otherwise(x))


def filled(c: Column) -> Column:
    """Whether a string is more than white space."""
    return c.rlike(NOT_WHITE)


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def lines_of(c: Column) -> Column:
    """The lines of a text; a line break at the end opens none."""
    return F.split(F.regexp_replace(c, f"(?:{P.LINE_BREAK})$", ""), P.LINE_BREAK)


def _bare(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKC", text).lower() if unicodedata.category(ch)[0] not in "PZ")


@F.pandas_udf(T.StringType())
def _bare_udf(texts):
    return texts.map(_bare, na_action="ignore")


@F.pandas_udf(T.StringType())
def _bare_once(texts):
    return texts.map(_bare, na_action="ignore")


#: For with_norm: filters on the normal form stay above it. Below, they would compute the form again for every condition.
_bare_once_udf = _bare_once.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bare_array_udf(arrays):
    return arrays.map(lambda xs: [None if x is None else _bare(x) for x in xs], na_action="ignore")


@F.pandas_udf(T.StringType())
def _wide_upper_udf(texts):
    return texts.map(lambda x: unicodedata.normalize("NFKC", x).upper(), na_action="ignore")


def plain(c: Column, dropped: bool = True) -> Column:
    """Whether a string's NFKC is that of its characters, one for one; dropped: but for punctuation and separators."""
    return c.rlike(_plain_pattern(dropped))


def nfkc(c: Column) -> Column:
    """The NFKC of plain strings."""
    return F.translate(c, *_forms())


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean_stem(c: Column | str) -> Column:
    """A stem without captions, section headings, question numbers and score marks; null counts as empty. Texts that have none of
    the characters without which nothing of that kind can be are only stripped line by line."""

    def line(x: Column) -> Column:
        once = lambda y, _: strip(F.regexp_replace(F.regexp_replace(y, P.LEADING_NUMBER, ""), P.LEADING_SCORE, ""))
        return F.when(x.rlike(P.LEADING), F.aggregate(F.sequence(F.lit(1), F.lit(3)), x, once)).otherwise(x)

    def lined(t: Column, f) -> Column:
        return strip(F.array_join(F.transform(lines_of(t), lambda x: f(strip(x))), "\n"))

    def cleaned(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, P.CHROME, ""), P.SECTION, " "), P.NUMBER_WITHIN, " ")
        maybe = F.when(ascii_only(t), t.rlike("[0-9]")).otherwise(t.rlike(P.MAYBE_NOISE))
        return F.when(maybe, lined(bare, line)).when(t.rlike(P.BREAKS), lined(t, lambda x: x)).otherwise(strip(t))

    return bound(F.coalesce(col(c), F.lit("")), cleaned)


def bare_native(c: Column) -> Column:
    """Lower case NFKC without punctuation and separators, for plain strings."""
    return F.regexp_replace(F.lower(nfkc(c)), DROPPED, "")


def _parted(c: Column | str) -> Column:
    """A struct of the normal form of a plain text, or else the clean text that NFKC must see; the other of both is null."""
    native = lambda x: F.when(ascii_only(x), F.regexp_replace(F.lower(x), DROPPED, "")).when(plain(x), bare_native(x))
    once = lambda x: bound(native(x), lambda n: F.struct(n.alias("native"), F.when(n.isNull(), x).alias("wide")))
    return bound(clean_stem(c), once)


def norm(c: Column | str) -> Column:
    """The form under which stems are compared: clean, NFKC, lower case, without punctuation and separators. An expression computes
    it twice; over many rows use with_norm."""
    clean = clean_stem(c)
    # not the struct's other field: Spark doesn't evaluate functions of expressions in which one lambda uses another one's variable
    return F.coalesce(_parted(c)["native"], _bare_udf(F.when(~plain(clean), clean)))


def with_norm(rows: DataFrame, name: str, source: Column | str, wide: bool = True) -> DataFrame:
    """rows with the normal form of a text as a further column, computed once. wide false: null, without Python, where NFKC is needed."""
    own = f"_{name}_parts"
    if not wide:
        return rows.withColumn(own, _parted(source)).withColumn(name, F.col(f"{own}.native")).drop(own)
    return rows.withColumn(own, _parted(source)).withColumn(name, F.coalesce(f"{own}.native", _bare_once_udf(f"{own}.wide"))).drop(own)


def norm_array(c: Column | str, wide: bool = True) -> Column:
    """norm of every element; a null array counts as empty, a null element as the empty string. wide: see with_norm."""

    def parted(ts: Column) -> Column:
        odd = F.exists(ts, lambda x: ~plain(x))
        return F.struct(F.when(~odd, F.transform(ts, bare_native)).alias("native"), F.when(odd, ts).alias("wide"))

    s = bound(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), clean_stem), parted)
    return F.coalesce(s["native"], _bare_array_udf(s["wide"])) if wide else s["native"]


def norm_answer(c: Column | str, wide: bool = True) -> Column:
    """Letters A to H run together if the answer is nothing but letters and separators, else the NFKC text in upper case, stripped and
    without one bracket at either end. Neither sorted nor without repeats; null counts as empty. wide: see with_norm."""
    t = F.coalesce(col(c), F.lit(""))
    upper = strip(F.coalesce(_wide_upper_udf(F.when(~plain(t, False), t)), F.upper(nfkc(t))) if wide else F.when(plain(t, False), F.upper(nfkc(t))))
    inner = F.regexp_replace(F.regexp_replace(upper, r"^[（(\[]", ""), r"[）)\]]$", "")
    return F.when(inner.rlike(P.LETTER_ANSWER), F.regexp_replace(inner, "[^A-H]", "")).otherwise(inner)


def is_generic(norm_stem: Column) -> Column:
    """Whether a normal stem is too short, alone or without common phrases, to identify a question."""
    maybe = ~ascii_only(norm_stem) & norm_stem.rlike(P.MAYBE_PHRASE)  # without such a character there is no phrase to take off
    return (F.length(norm_stem) < SHORT_STEM) | (maybe & (F.length(F.regexp_replace(norm_stem, P.PHRASE, "")) < SHORT_REST))


def canonical_options(norm_options: Column) -> Column:
    """The multiset of normal options as one string."""
    return F.array_join(F.array_sort(norm_options), "\x1f")


def stem_key(norm_stem: Column, norm_options: Column) -> Column:
    """The identity of a question: SHA-1 of its normal stem, and of its options too where the stem is generic."""
    tail = F.when(is_generic(norm_stem), F.concat(F.lit("\x00"), canonical_options(norm_options))).otherwise(F.lit(""))
    return F.sha1(F.concat(norm_stem, tail).cast("binary"))


def letters_of(normal_answer: Column) -> Column:
    return F.regexp_extract_all(normal_answer, F.lit("([A-H])"), F.lit(1))


def answer_text(normal_answer: Column, options: Column) -> Column:
    """The texts of the options that an answer names, joined; letters without an option are passed over; null if none is left."""
    at = F.transform(letters_of(normal_answer), lambda x: F.try_element_at(options, F.ascii(x) - 64))
    picked = F.filter(at, lambda x: x.isNotNull())
    return F.when(F.size(picked) > 0, F.array_join(picked, P.ANSWER_JOIN))


def options_of_string(c: Column | str) -> Column:
    """Options given as one string."""
    return F.filter(F.transform(F.split(col(c), P.OPTION_SEPARATOR), strip), lambda x: x != "")


def options_of_map(c: Column | str) -> Column:
    """Options given by letter."""
    return F.transform(F.array_sort(F.map_keys(col(c))), lambda k: strip(F.coalesce(F.element_at(col(c), k), F.lit("None"))))


def options_of_structs(c: Column | str, field: str = "text") -> Column:
    """Options given as structs with a text."""
    return F.transform(col(c), lambda o: strip(F.coalesce(o[field], F.lit("None"))))


def first_filled(*cols: Column | str) -> Column:
    """The first string that isn't null or empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cols))
