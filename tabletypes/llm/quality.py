"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a and as at be by for from in is it of on or that the this to was with "
    "auf das den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de du elle en est et il la le les par pas pour que qui sur un une "
    "al como con del el es las lo los más no o para por se su y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= measure / per <= high; a text without ``per`` passes."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=10, high=1_000_000),
    Rule("word_length", "word_chars", "n_words", low=2, high=16),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("exclamations", "n_marks", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.2),
)


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``measures`` of the counts that rules may name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(*docs.columns).alias("row")
    split = docs.select(
        kept,
        text.alias("t"),
        F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
    )
    n = F.size("w")
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def five(array: str, at: Column, join) -> Column:
        return join(*[F.get(F.col(array), at + i) for i in range(5)])

    starts = F.sequence(F.lit(0), n - 5)
    # equal hashes only tell which texts need the comparison of the words themselves
    wins = hashed.withColumn("wins", F.when(n >= 5, F.transform(starts, lambda i: five("h", i, F.xxhash64))))
    again = F.size("wins") > F.size(F.array_distinct("wins"))
    sorted_ = wins.withColumn("s", F.when((n >= 5) & again, F.array_sort(F.transform(starts, lambda i: F.struct(five("w", i, lambda *x: F.concat_ws(" ", *x)).alias("g"), i.alias("i"))))))
    twin = lambda x, k: (F.get("s", k - 1)["g"] == x["g"]) | (F.get("s", k + 1)["g"] == x["g"])
    found = sorted_.withColumn("at", F.array_sort(F.transform(F.filter("s", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    long = lambda c: c.cast("long")
    return found.select(
        "row",
        F.struct(
            long(n).alias("n_words"),
            long(F.length("t") - _count(F.col("t"), SPACES)).alias("word_chars"),
            long(_count(F.col("t"), SYMBOLS)).alias("n_symbols"),
            long(_count(F.col("t"), "!?")).alias("n_marks"),
            long(F.size("lines")).alias("n_lines"),
            long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
            long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
            long(F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
        ).alias("measures"),
    ).select("row.*", "measures")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row with ``measures`` breaks, as one array."""
    broken = []
    for r in rules:
        value = F.col(f"measures.{r.measure}")
        bounds = F.lit(False)
        by = F.col(f"measures.{r.per}") if r.per else F.lit(1)
        if r.low is not None:
            bounds |= value < r.low * by
        if r.high is not None:
            bounds |= value > r.high * by
        broken.append(F.when(bounds & (by > 0), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the names of the broken rules.

    Words are runs of characters other than space and U+0009 to U+000D, over whole texts. A null text counts as empty: no words, so the base rule fails.
    Equal rows give equal results; ids may be null; columns of ``docs`` other than the id and the text are not read.
    """
    rows = measures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    m = F.col("measures")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    rows = rows.select("id", "measures", failed.alias("base_failed"), verdict(rules).alias("broken_rules"))
    return rows.select(
        F.col("id").alias(id_col),
        *[F.col(f"measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"),
        F.concat_ws(",", "broken_rules").alias("broken_rules"),
    )
