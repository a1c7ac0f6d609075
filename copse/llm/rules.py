"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pinned, put, quoted, words

#: Words of a window, and the least number of words and the largest share of repeated words of a text.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "for", "it", "was",
              "der", "die", "das", "und", "ist", "nicht", "von", "mit", "zu", "den", "ein",
              "le", "la", "les", "de", "et", "en", "un", "une", "des", "que", "pour", "est",
              "el", "los", "las", "y", "del", "por", "con", "una", "se")
#: (measure, comparison, bound): a text fails where the comparison holds.
RULES = (
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 14.0),
    ("symbol_ratio", ">", 0.10),
    ("stop_ratio", "<", 0.02),
    ("dup_line_ratio", ">", 0.50),
)


def repeated_words(array: str, window: int = WINDOW) -> Column:
    """How many words of the array column lie in windows that occur twice or more.

    Hashes of all windows come first; only where two are equal are windows sorted by their words.
    """
    n, m = f"size({array})", f"size({array}) - {window - 1}"
    gram = f"slice({array}, i, {window})"
    let = "element_at(transform(array({}), {} -> {}), 1)".format
    hashes = f"transform(sequence(1, {m}), i -> xxhash64({gram}))"
    in_order = f"sort_array(transform(sequence(1, {m}), i -> named_struct('h', xxhash64({gram}), 'w', {gram}, 'i', i)))"
    twin = "(s[j {0} 1].h = e.h and s[j {0} 1].w = e.w)".format
    starts = let(in_order, "s", f"sort_array(filter(transform(s, (e, j) -> if((j > 0 and {twin('-')}) or (j < size(s) - 1 and {twin('+')}), e.i, 0)), p -> p > 0))")
    covered = let(starts, "p", f"aggregate(transform(p, (v, j) -> if(j = size(p) - 1, {window}, least({window}, p[j + 1] - v))), 0, (x, y) -> x + y)")
    return F.expr(f"case when {n} <= {window} then 0 when size(array_distinct({hashes})) = {m} then 0 else {covered} end").cast("long")


def measures(text: Column, array: Column) -> dict[str, Column]:
    """Counts of a text; array: its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return {
        "n_words": F.size(array).cast("long"),
        "word_chars": F.length(F.array_join(array, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(array, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    }


def ratios() -> dict[str, Column]:
    one = F.lit(1).cast("long")
    words_ = F.greatest(F.col("n_words"), one)
    return {
        "mean_word_chars": F.col("word_chars") / words_,
        "symbol_ratio": F.col("n_symbols") / words_,
        "stop_ratio": F.col("n_stop_words") / words_,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), one),
    }


def compiled(rules=RULES) -> Column:
    """True where no rule fails."""
    of, ok = ratios(), F.lit(True)
    for name, sign, bound in rules:
        value = of[name] if name in of else F.col(name)
        ok = ok & ~(value > bound if sign == ">" else value < bound)
    return ok


def quality_rules(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words, base_failed and kept.

    A null text counts as empty; a text without words fails the base rules.  Columns of df with these
    names are replaced; rows are judged one by one, so ties and repeats change nothing.
    """
    array, found = fresh(df, "x_words", "x_found")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = pinned(df, array, words(text))
    counts = measures(text, F.col(array)) | {"n_repeat_words": repeated_words(quoted(array))}
    rows = pinned(rows, found, F.struct(*[v.alias(k) for k, v in counts.items()]))
    rows = put(rows, **{k: F.col(f"{found}.{k}") for k in counts})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = put(rows, base_failed=failed)
    return put(rows, kept=~F.col("base_failed") & compiled(rules)).drop(array, found)
