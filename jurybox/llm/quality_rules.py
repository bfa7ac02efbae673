"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import evaluated, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "it", "as", "on", "be", "at", "by", "this",
    "are", "from", "or", "an", "a", "not",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "qui", "par", "au",
    "der", "die", "und", "das", "ist", "von", "zu", "den", "mit", "für", "auf", "ein", "eine", "im", "dem",
    "el", "los", "las", "y", "se", "por", "con", "para", "una", "del", "es", "lo", "como",
)
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    """A document passes if `low <= ratio <= high`; texts under `min_words` words are not judged by the rule."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("lines", "duplicate_line_share", None, 0.4),
    Rule("letters", "letter_word_share", 0.7, None, 20),  # a phone number or a key must not decide on a short text
    Rule("stop_words", "stop_word_share", 0.04, None, 40),
)


def share(part: str, whole: str) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _covered(positions: Column, width: int) -> Column:
    """Places covered by intervals of `width` that begin at the sorted `positions`."""
    gaps = F.transform(positions, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(positions, i + 1), p + width) - p))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)


def measures(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add one struct column `q` of counts to `df`; no other column is touched.

    Null text counts as empty. Repeated windows are found by hash first; only texts
    that repeat a hash are compared by their words, so a hash collision changes nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")]
    split = df.select(
        *keep, words_of(t).alias("w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
    )
    w, n = F.col("w"), F.size("w")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    hashed = split.select("*", F.transform(
        starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])).alias("hashes"))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    exact = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.slice(w, i + 1, window)).alias("s"), i.alias("i"))))
    listed = hashed.select(
        "row", "n_symbols", "word_chars", n.cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(F.trim(x, F.lit(".,;:!?()\"'"))).isin(*STOP_WORDS))).cast("bigint").alias("n_stop"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("bigint").alias("n_letter_words"),
        F.when(repeats, exact).alias("pairs"),
    )
    pairs = F.col("pairs")
    again = F.sort_array(F.transform(F.filter(
        pairs, lambda x, j: F.coalesce(F.get(pairs, j - 1)["s"] == x["s"], F.lit(False))
        | F.coalesce(F.get(pairs, j + 1)["s"] == x["s"], F.lit(False))), lambda x: x["i"].cast("bigint")))
    placed = listed.select("*", again.alias("again"))
    counted = placed.select("*", F.coalesce(_covered(F.col("again"), window), F.lit(0).cast("bigint")).alias("n_repeat_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_letter_words")
    return counted.select("row", F.struct(*names).alias("q"))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail, as one array column over the struct `q`."""
    ratios = {
        "mean_word_chars": share("q.word_chars", "q.n_words"),
        "symbols_per_word": share("q.n_symbols", "q.n_words"),
        "duplicate_line_share": share("q.n_dup_lines", "q.n_lines"),
        "letter_word_share": share("q.n_letter_words", "q.n_words"),
        "stop_word_share": share("q.n_stop", "q.n_words"),
    }
    failed = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (ratios[rule.ratio] < rule.low)
        if rule.high is not None:
            bad = bad | (ratios[rule.ratio] > rule.high)
        failed.append(F.when(bad & (F.col("q.n_words") >= rule.min_words), F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def judge_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of `df` as struct `row`, with counts `q`, `base_failed`, failed rule names and `kept`.

    Base: under 10 words, or over 20 % of the words in 5-word windows that occur
    twice. A document is kept if neither base nor a rule fails it. Null and empty
    texts have no words and fail the base. Each row is judged by itself: repeated
    rows, ties and columns of any name stay as they are (inside `row`); an empty
    table gives an empty table.
    """
    measured = measures(df, text)
    base = (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words"))
    judged = measured.select("row", "q", base.alias("base_failed"), compile_rules(rules).alias("failed_rules"))
    return judged.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `df` that the rules keep, with the columns of `df`; cases are decided as in `judge_quality`."""
    return evaluated(judge_quality(df, text, rules)).where("kept").select("row.*")
