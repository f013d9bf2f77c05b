"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

A rule is (name, measure, least, most); a bound that is None is open.  ``compile_rules`` turns the
table into one struct column, so a text is read once and no user function runs.  Measures are counts
over the whole text and ratios of them; the three-word windows and the lines are compared exactly.

Words are runs of ``[^\\x20\\x09-\\x0D]+``.  A null text has no words.  The ratios of an empty text are
0.  Repeated rows are judged alike; extra columns are kept as they are, except that a column named
``quality`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it be for with was as by on are this from at an or not "
    "der die das und in zu den von mit sich des auf ist im dem nicht ein eine als für "
    "de la le et les des en un une du que est pour qui dans par sur au pas avec "
    "el los las del y se por con no su para es al lo como más una"
).split()

# The production thresholds.
RULES = (
    ("mean_word", "mean_word", 2.0, 14.0),
    ("symbols_per_word", "symbols_per_word", None, 0.15),
    ("stop_word_ratio", "stop_word_ratio", 0.02, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Only windows whose hash repeats are compared as text, so that a text without repeats costs one
    hash per word.
    """
    n = F.size(words)

    def at(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def twice(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        """Elements of a sorted array that equal a neighbour."""
        beside = lambda x, i: F.coalesce(same(x, F.get(s, i)), F.lit(False))
        return F.filter(s, lambda x, i: beside(x, i - 1) | beside(x, i + 1))

    def exactly(candidates: Column) -> Column:
        texts = F.transform(
            candidates,
            lambda c: F.struct(F.struct(*at(c["at"])).alias("window"), c["at"].alias("at")),
        )
        found = let(F.sort_array(texts), lambda s: twice(s, lambda x, y: x["window"] == y["window"]))
        places = F.transform(found, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    def by_hash(hashes: Column) -> Column:
        pairs = F.arrays_zip(hashes.alias("hash"), F.sequence(F.lit(0), n - 3).alias("at"))
        repeated = let(F.sort_array(pairs), lambda s: twice(s, lambda x, y: x["hash"] == y["hash"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            exactly(repeated)
        )

    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*at(i)))
    return F.when(n < 4, F.lit(0)).otherwise(let(hashed, by_hash))


def measures(text: Column) -> Column:
    """Struct of counts and ratios of a text."""
    body = F.coalesce(text, F.lit(""))
    inner = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE, -1))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).alias("stop_words"),
        )

    counted = F.struct(
        let(words, of).alias("w"),
        F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))).alias("l"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)

    def named(c: Column) -> Column:
        w, dup = c["w"], c["l"]["n"] - c["l"]["kinds"]
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            ratio(w["word_chars"], w["n_words"]).alias("mean_word"),
            ratio(c["n_symbols"], w["n_words"]).alias("symbols_per_word"),
            ratio(w["stop_words"], w["n_words"]).alias("stop_word_ratio"),
            ratio(dup, c["l"]["n"]).alias("dup_line_ratio"),
        )

    return let(counted, named)


def compile_rules(measured: Column, rules=RULES) -> Column:
    """Array of the names of the rules that a struct of measures breaks."""
    broken = []
    for name, measure, least, most in rules:
        bounds = [measured[measure] < least] if least is not None else []
        bounds += [measured[measure] > most] if most is not None else []
        for bound in bounds:
            broken.append(F.when(bound, F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules=RULES, column: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with one more struct column: the measures, base_failed, the rules broken, and kept.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    """

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        broken = compile_rules(m, rules)
        return F.struct(
            m.alias("measures"),
            failed.alias("base_failed"),
            broken.alias("broken"),
            (~failed & (F.size(broken) == 0)).alias("kept"),
        )

    return docs.withColumn(into, let(measures(F.col(column)), verdict))
