"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in expressions on one row at a time: no user function, no
shuffle, no window.  The table below is data; :func:`compile_rules` turns it
into one boolean expression over the measured ratios.

Defined results: null and empty texts have zero for all counts and fail the
base rule (fewer than 20 words); repeated rows are judged alike; very long
texts are read whole; the filter keeps all columns as they are, whatever their
names, in a struct of their own.  The stop words are those of the languages in
``STOP_WORDS``: a text in a language that shares none of them has a ratio of 0
and fails, so a corpus in other languages needs their words in that table, or a
table of rules without that ratio.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import SPACES, WORD

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MARKS = ".,;:!?()\"'"

#: Frequent function words of the languages at hand, for the stop-word ratio.
STOP_WORDS = {
    "en": "the of and to in for is on that by this with it as was are at from be an or".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
}

#: measure, comparison that fails the document, threshold.
RULES: list[tuple[str, str, float]] = [
    ("mean_word_length", "<", 1.5),
    ("mean_word_length", ">", 20.0),
    ("symbol_ratio", ">", 0.2),
    ("stop_word_ratio", "<", 0.05),
    ("bang_ratio", ">", 0.3),
    ("dup_line_ratio", ">", 0.5),
]


def _let(value: Column, body) -> Column:
    """Bind *value* once and build an expression from it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def repeated_words(word_array: Column, width: int = WINDOW) -> Column:
    """Words inside windows of *width* words that occur twice or more, first included.

    Each word is hashed once; windows of 2, 4 and 8 words are hashed from two
    windows of half the width, as long as any of these repeats (*width* is a
    power of two).  Only texts with a repeated window pay for sorting (hash,
    position) pairs.
    """

    def cover(wins: Column) -> Column:
        pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated_positions(p: Column) -> Column:
            twin = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            own = F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(pairs, lambda p: _let(repeated_positions(p), covered))

    def joined(h: Column, reach: int) -> Column:
        """Hashes of pairs that lie *reach* apart: windows of twice that width."""
        n = F.size(h) - reach
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(reach + 1), n), lambda a, b: F.xxhash64(a, b))

    def unless_distinct(h: Column, then) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(then(h))

    def doubled(h: Column, reach: int) -> Column:
        # a repeated window holds repeated windows of half its width
        if reach == width:
            return unless_distinct(h, cover)
        return unless_distinct(h, lambda x: _let(joined(x, reach), lambda y: doubled(y, 2 * reach)))

    few = F.size(word_array) < width
    return F.when(few, F.lit(0).cast("long")).otherwise(_let(F.transform(word_array, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)))


def stop_words_in(word_array: Column) -> Column:
    """Words that are stop words once marks at their ends are taken off."""
    every = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return F.size(F.filter(word_array, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(every)))


def measures(text: Column) -> Column:
    """One struct with the base counts and the counts behind the ratios."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def build(w: Column) -> Column:
        return _let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                stop_words_in(w).cast("long").alias("n_stop_words"),
                (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bangs"),
            ),
        )

    return _let(words(text), build)


def ratios(m: Column) -> dict[str, Column]:
    n = F.greatest(m["n_words"], F.lit(1))
    return {
        "mean_word_length": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / n,
        "stop_word_ratio": m["n_stop_words"] / n,
        "bang_ratio": m["n_bangs"] / n,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    }


def compile_rules(m: Column, rules: list[tuple[str, str, float]] = RULES) -> Column:
    """True where no rule of the table fails."""
    r = ratios(m)
    failed = [r[name] < limit if op == "<" else r[name] > limit for name, op, limit in rules]
    return ~reduce(lambda a, b: a | b, failed, F.lit(False))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def judge(docs: DataFrame, rules: list[tuple[str, str, float]] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row."""
    m = F.col("m")
    out = docs.select("doc_id", measures(F.col("text")).alias("m"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[m[c].alias(c) for c in base], base_failed(m).alias("base_failed"), (~base_failed(m) & compile_rules(m, rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[tuple[str, str, float]] = RULES) -> DataFrame:
    """The rows of *docs*, all columns as they are, that pass every rule."""
    m = F.col("m")
    measured = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), measures(docs["text"]).alias("m"))
    return measured.where(~base_failed(m) & compile_rules(m, rules)).select("row.*")
