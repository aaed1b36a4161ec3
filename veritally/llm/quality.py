"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

Every figure is taken from the whole text. A null or empty text has no words,
so it fails the length rule. A rule whose figure is undefined (a ratio without
a denominator) doesn't fail. Rows are judged alone: repeated rows get the same
verdict, an empty table gives an empty result, and other columns of the input,
whatever their names, pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import WHITE, WHITE_CHARS, let

SYMBOLS = "#*$%&|<>"
BULLETS = "[-*•]"

# Frequent function words of the languages the rules know.
STOP_WORDS = {
    "en": "the of and to in is that for it on with as was at by this be are from or an have not",
    "de": "der die und das von zu mit den ist im des ein eine auf nicht sich auch dem als für an es",
    "fr": "le la les de des et un une du dans que qui est pour par sur au en pas ne se ce il",
    "es": "el la los las de que y en un una del por con para es se no su lo al como más",
}


@dataclass(frozen=True)
class Rule:
    """Reject where ``figure`` is below ``least`` or above ``most``."""

    name: str
    figure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("too_few_words", "n_words", least=50),
    Rule("repeated_windows", "repeat_ratio", most=0.5),
    Rule("odd_word_length", "mean_word_chars", least=2, most=20),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.5),
    Rule("no_stop_words", "n_stop_words", least=2),
)


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    windows = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )

    def covered(hashes: Column) -> Column:
        def starts(pairs: Column) -> Column:
            same = lambda x, k: (x.h == F.get(pairs, k - 1).h) | (x.h == F.get(pairs, k + 1).h)
            twice = F.filter(pairs, lambda x, k: F.coalesce(same(x, k), x.h == F.get(pairs, k + 1).h, x.h == F.get(pairs, k - 1).h))
            return F.sort_array(F.transform(twice, lambda x: x.i))

        def total(found: Column) -> Column:
            gaps = F.transform(found, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(found, k + 1) - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(ordered, lambda pairs: let(starts(pairs), total))
        )

    return let(windows, covered)


def figures(text: Column) -> Column:
    """A struct of all figures of one text; counts are exact and cover the whole text."""
    text = F.coalesce(text, F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()})])

    def measured(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, WHITE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*" + BULLETS))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.array_intersect(F.split(F.lower(text), WHITE), stop)).cast("long").alias("n_stop_words"),
        )

    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda v: measured(v.w, v.l))


def ratios(f: Column) -> dict[str, Column]:
    """The figures a rule may name."""

    def per(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    return {
        "n_words": f.n_words,
        "n_stop_words": f.n_stop_words,
        "mean_word_chars": per(f.word_chars, f.n_words),
        "symbols_per_word": per(f.n_symbols, f.n_words),
        "repeat_ratio": per(f.n_repeat_words, f.n_words),
        "dup_line_ratio": per(f.n_dup_lines, f.n_lines),
        "bullet_line_ratio": per(f.n_bullet_lines, f.n_lines),
        "ellipsis_line_ratio": per(f.n_ellipsis_lines, f.n_lines),
    }


def failed(f: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text breaks, as an array in the table's order."""
    known = ratios(f)
    broken = []
    for rule in rules:
        x = known[rule.figure]
        out = F.lit(False)
        if rule.least is not None:
            out = out | (x < rule.least)
        if rule.most is not None:
            out = out | (x > rule.most)
        broken.append(F.when(out, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column of the figures, the failed rules and the verdict."""
    value = let(figures(F.col(f"`{text}`")), lambda f: f.withField("failed", failed(f, rules)))
    return docs.withColumn(into, value)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that break no rule, with the columns they came with."""
    good = let(figures(F.col(f"`{text}`")), lambda f: F.size(failed(f, rules)) == 0)
    return docs.filter(good)
