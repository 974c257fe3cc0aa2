"""Quality rules, line first: each line is judged, failing lines go, and a document that loses too much text goes.

A line fails as badly punctuated (symbols, or shouting), as navigation (bars and arrows between
short items) or as boilerplate (stock phrases, or a line said before). Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._native import let, quoted, text, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Percent of a text's words in repeated 3-word windows, above which it fails.
MOST_REPEATED = 50
#: A line's symbols per 100 words, exclamation marks per 100 words, and bars per 100 words, above which it fails.
LINE_SYMBOLS, LINE_SHOUTS, LINE_BARS = 40, 40, 20
#: Percent of a text's word characters in failing lines, above which the text is rejected.
MOST_LOST = 30
#: Phrases of lines that no reader came for; a line of at most BOILER_CHARS characters with one fails.
BOILERPLATE = r"(?i)\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|log ?in|subscribe (now|to)|share (this|on)|read more|skip to (main )?content|back to top|lorem ipsum|javascript)\b"
BOILER_CHARS = 200


#: Bits of a place among a text's windows; a text has fewer windows than bytes, and at most 2 ** 31 of those.
_PLACE_BITS = 31


def _solid(value: Column) -> Column:
    """How many code points of a value stand in words."""
    return F.length(F.regexp_replace(value, r"[\x20\x09-\x0D]+", ""))


def _count(value: Column, marks: str) -> Column:
    return F.regexp_count(value, F.lit(f"[{marks}]"))


def _window(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _windows(w: Column) -> Column:
    """The 3-word windows of w as sorted numbers: upper bits of the hash, then the place."""
    places = F.when(F.size(w) >= 4, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, lambda i: F.shiftleft(_window(w, i), _PLACE_BITS).bitwiseOR(i.cast("bigint"))))


def _repeats(w: Column, windows: Column) -> Column:
    """How many of the words w stand in 3-word windows found twice or more.

    Windows are told apart by 64-bit hashes: only those with a neighbour alike in the upper bits are
    looked at in full.
    """
    alike = lambda x, y: x.bitwiseXOR(y).between(0, (1 << _PLACE_BITS) - 1)
    some = F.filter(windows, lambda x, k: alike(x, F.get(windows, k - 1)) | alike(x, F.get(windows, k + 1)))
    at = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    whole = lambda xs: F.sort_array(F.transform(xs, lambda x: F.struct(_window(w, at(x)).alias("h"), at(x).alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    places = let(whole(some), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    own = lambda at: F.transform(at, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(at, k - 1))))
    return let(places, lambda at: F.aggregate(own(at), F.lit(0), lambda a, x: a + x))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule of its own; counts are per word, so a mark or two in prose does no harm."""
    n = F.size(words(line))
    bars = _count(line, "|»›•")
    marked = (100 * _count(line, "#*$%&<>") > LINE_SYMBOLS * n) | (100 * _count(line, "!?") > LINE_SHOUTS * n) | ((100 * bars > LINE_BARS * n) & (bars >= 3))
    boiler = (F.length(line) <= BOILER_CHARS) & line.rlike(BOILERPLATE)
    return F.when(line.rlike("[#*$%&<>!?|»›•]"), marked | boiler).otherwise(boiler)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _judged(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, `_t` its text and `_m` its measures.

    Few columns, as Spark's planning time doubles with each that a filter has below it, and each
    used by several expressions, so that none is worked out twice.
    """
    t = docs.withColumn("_t", text())
    lines = let(F.filter(F.split("_t", "\n"), _has_word), lambda x: F.struct(F.size(x).alias("n"), F.array_distinct(x).alias("once")))
    t = t.withColumn("_w", words(F.col("_t"))).withColumn("_l", lines)
    t = t.withColumn("_s", _windows(F.col("_w")))
    # a line stays if no rule fails it, and once; all else is lost, whatever was wrong with it
    stays = F.aggregate("_l.once", F.lit(0), lambda a, x: a + F.when(line_fails(x), 0).otherwise(_solid(x)))
    facts = {
        "n_words": F.size("_w"), "word_chars": F.length(F.array_join("_w", "")), "n_symbols": _count(F.col("_t"), SYMBOLS), "n_dup_lines": F.col("_l.n") - F.size("_l.once"),
        "n_repeat_words": _repeats(F.col("_w"), F.col("_s")), "stays": stays,
    }
    return t.withColumn("_m", let(F.struct(*[v.cast("bigint").alias(k) for k, v in facts.items()]), lambda m: m))


def _lost() -> Column:
    return F.col("_m.word_chars") - F.col("_m.stays")


def _base_failed() -> Column:
    return (F.col("_m.n_words") < LEAST_WORDS) | (100 * F.col("_m.n_repeat_words") > MOST_REPEATED * F.col("_m.n_words"))


def _clean_enough() -> Column:
    return 100 * _lost() <= MOST_LOST * F.col("_m.word_chars")


def _kept() -> Column:
    """The verdict; a condition that isn't deterministic is not pushed down, where the measures would be worked out again for every use."""
    return ~_base_failed() & _clean_enough() & (F.monotonically_increasing_id() >= 0)


def _cleaned(value: Column) -> Column:
    """The text without lines that fail and without lines said before; lines without words stay.

    Those get a mark that no line can hold, a line feed, and their number, so that only others are merged.
    """
    marked = F.transform(F.split(value, "\n"), lambda x, i: F.when(_has_word(x), x).otherwise(F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), x)))
    passing = F.filter(F.array_distinct(marked), lambda x: x.startswith("\n") | ~line_fails(x))
    return F.array_join(F.transform(passing, lambda x: F.when(x.startswith("\n"), F.substring_index(x, "\n", -1)).otherwise(x)), "\n")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars) of every row.

    A null or empty text has no words and fails, and so does any text under LEAST_WORDS words; one of
    any length is judged whole. Repeated rows are judged each; an empty table gives no rows. Columns
    other than doc_id (null or not) and text aren't looked at, whatever they are called.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _judged(rows).select("doc_id", *[f"_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], _base_failed().alias("base_failed"), _kept().alias("kept"), _lost().alias("lost_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, whatever they are called.

    The text is without failing and repeated lines; n_chars, if there, is its length. Rows are judged
    as by `measure`: null and short texts go, repeated rows stay or go together.
    """
    mine = docs.columns
    rows = docs.select(F.struct(*map(quoted, mine)).alias("_row"), F.col("text"))
    kept = _judged(rows).withColumn("_keep", _kept()).where("_keep")
    less = _lost() > 0
    kept = kept.select("_row", less.alias("_less"), F.when(less, _cleaned(F.col("_t"))).otherwise(F.col("_t")).alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in mine:
        new["n_chars"] = F.when(F.col("_less"), F.length("_clean")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in mine])
