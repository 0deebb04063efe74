"""Quality rules: a threshold table compiled into one projection.

All measures are built-in expressions on the row's own text, so the plan is
scan and project; nothing is shuffled and no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.llm import text as T

WINDOW = 5
#: Frequent function words of the languages the rules are for.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "at", "this",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "im", "nicht", "ein", "eine", "auf", "für", "des", "dem", "sich",
    "le", "la", "les", "de", "et", "des", "un", "une", "du", "que", "qui", "dans", "pour", "est", "pas", "par", "sur", "au", "avec", "il", "elle",
    "el", "los", "las", "y", "en", "del", "se", "por", "con", "no", "para", "su", "lo", "una",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= top / bottom <= high, once it has ``words`` words.

    ``top`` and ``bottom`` name measures; an undefined ratio passes.
    """

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: The threshold table.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.3),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop words", "n_stop_words", "n_words", 0.02, None, words=100),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column) -> Column:
    """How many words lie in 5-word windows found twice or more, from word hashes.

    A set of window hashes tells whether there are any; only then are windows
    sorted, starts of equal neighbours kept, and their cover added up.
    """
    windows = F.when(F.size(hashes) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))))

    def twins(order: Column) -> Column:
        return F.filter(order, lambda x, k: (F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]))

    def reach(start: Column) -> Column:
        return F.aggregate(F.transform(start, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(start, k + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

    def cover(hashed: Column) -> Column:
        order = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(order, lambda o: bound(F.sort_array(F.transform(twins(o), lambda x: x["i"])), reach))

    return F.coalesce(bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), cover(w))), F.lit(0))


def measures(text: Column, words: Column, hashes: Column, lines: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Struct of the measures, all long."""
    stops = F.array(*(F.xxhash64(F.lit(w)) for w in stop_words))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(hashes),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(hashes, lambda h: F.array_contains(stops, h))),
    }
    return F.struct(*(v.cast("long").alias(k) for k, v in counts.items()))


def verdict(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The table as one condition over a struct of measures."""
    passed = F.lit(True)
    for r in rules:
        ratio = m[r.top] / F.when(m[r.bottom] > 0, m[r.bottom])
        held = F.lit(True)
        held = held & (ratio >= r.low) if r.low is not None else held
        held = held & (ratio <= r.high) if r.high is not None else held
        passed = passed & (F.coalesce(held, F.lit(True)) | (m["n_words"] < r.words))
    return passed


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def judged(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct of measures, base_failed and kept: one expression that any filter can use."""
    lines = F.filter(F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    every = bound(T.words(text), lambda w: bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: bound(lines, lambda n: measures(text, w, h, n))))

    def decided(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*(m[c].alias(c) for c in MEASURES), failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    return bound(every, decided)


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the measures, base_failed (under 10 words, or over a fifth of them repeated) and kept.

    One row per row of ``docs``; repeated rows are judged alike, NULL and empty
    texts have no word and fail, columns of the added names are replaced, and
    an empty table gives an empty table.
    """
    added = (*MEASURES, "base_failed", "kept")
    kept = [c for c in docs.columns if c not in added]
    one = docs.select(*(F.col(f"`{c}`") for c in kept), judged(F.col(f"`{text}`"), rules).alias("_judged"))
    return one.select(*(F.col(f"`{c}`") for c in kept), *(F.col("_judged")[c].alias(c) for c in added))
