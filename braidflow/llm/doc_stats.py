"""Per-document statistics as plain Spark expressions; one pass over the text, no shuffle.

Null text counts as empty. Every count covers the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: The columns that rules and classifiers may use; each is a double and never null.
FEATURES = (
    "f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeats", "f_bangs", "f_line_words",
)
#: The counts that come with them, as longs.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` and :data:`FEATURES`.

    ``n_repeat_words`` counts the words that lie in a 3-word window which occurs twice or more in the text. Windows
    are compared by 64-bit hashes. Windows that occur once in a text (most texts have no other) cost one hash set;
    only texts with a repeat sort their windows, so that a text of any length stays in n log n.
    Columns of ``docs`` that bear the name of a statistic, or one that begins with ``_s_``, give way.
    """
    keep = [c for c in docs.columns if not c.startswith("_s_") and c not in (*COUNTS, *FEATURES)]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    a = docs.select(*keep, words(t).alias("_s_w"), lines.alias("_s_l"), t.alias("_s_t"))
    without = lambda c: F.length("_s_t") - F.length(F.replace(F.col("_s_t"), F.lit(c), F.lit("")))
    a = a.select(
        *keep,
        F.transform("_s_w", lambda w: F.xxhash64(w)).alias("_s_w"),
        F.length(F.array_join("_s_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_s_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        without("!").cast("double").alias("_s_bangs"),
        F.size("_s_l").cast("long").alias("n_lines"),
        (F.size("_s_l") - F.size(F.array_distinct("_s_l"))).cast("long").alias("n_dup_lines"),
    )
    at = lambda i: F.get(F.col("_s_w"), i)
    windows = F.when(
        F.size("_s_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_s_w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    plain = [c for c in a.columns if c not in keep and c != "_s_w"]
    b = a.select(
        *keep, *plain, F.size("_s_w").cast("long").alias("n_words"), windows.alias("_s_h")
    )
    has_repeat = F.size(F.array_distinct("_s_h")) < F.size("_s_h")
    stats = [c for c in b.columns if c not in keep and c != "_s_h"]
    c = b.select(*keep, *stats, F.when(has_repeat, F.sort_array(F.transform("_s_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s_o"))
    same = lambda x, k: F.get(F.col("_s_o"), k)["h"] == x["h"]
    twice = F.filter("_s_o", lambda x, k: ((k > 0) & same(x, k - 1)) | F.coalesce(same(x, k + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    d = c.select(*keep, *stats, F.coalesce(F.when(F.col("_s_o").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"))
    share = lambda x, of: F.col(x) / F.greatest(F.col(of), F.lit(1))
    values = F.struct(
        *COUNTS,
        F.col("n_words").cast("double").alias("f_words"),
        share("word_chars", "n_words").alias("f_word_len"),
        share("n_symbols", "word_chars").alias("f_symbols"),
        share("n_dup_lines", "n_lines").alias("f_dup_lines"),
        share("n_repeat_words", "n_words").alias("f_repeats"),
        share("_s_bangs", "n_words").alias("f_bangs"),
        share("n_words", "n_lines").alias("f_line_words"),
    )
    # A generator of one row: filters on the statistics stay above it. Pushed below, they would compute each one anew
    # wherever the filter names it, and put the arrays' own making inside the functions that walk over them.
    return d.select(*keep, F.inline(F.array(values)))


def thresholds(sample: DataFrame, bins: int = 24) -> dict[str, list[float]]:
    """Distinct inner quantiles of every feature over ``sample``: the cut points that learners may choose from."""
    at = [k / bins for k in range(1, bins)]
    row = sample.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(row[f] or [])) for f in FEATURES}


def bin_of(feature: str, cuts: list[float]):
    """The number of cut points below the value: 0 to ``len(cuts)``."""
    return sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
