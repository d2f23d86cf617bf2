"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base measures come from each whole text. Each rule compares one measure with
a cutoff; cutoffs are learned per stratum from labelled documents that pass
the base rules, so that the share of good documents a rule rejects is at most
:data:`RISK` divided by the number of rules, with confidence 1 -
:data:`ERROR` over all strata and rules together.

For every stratum, rule and cutoff of a fixed grid, the exact binomial tail
P(Bin(n, risk) <= k) is the p-value of "the rule rejects more than the limit",
k being the good documents it rejects of n. Cutoffs are tested from lenient to
strict and testing stops at the first that fails (a fixed sequence, which
needs no correction within it); over strata and rules the level is divided
(Bonferroni). Of the certified cutoffs the one with the largest difference
between rejected bad and good shares is used, the most lenient of equals. A
stratum with too few labels has no certified cutoff: its rule stays off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
RISK = 0.05
ERROR = 0.05
#: measure -> cutoffs from lenient to strict; a document above its cutoff is rejected
RULES = {
    "symbols": (4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3),
    "repeats": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "word_length": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0),
}
MAX_BROADCAST_STRATA = 10_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def repeated(h: Column) -> Column:
            placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            twice = let(placed, lambda s: F.filter(
                s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.when(F.size(F.array_distinct(h)) < F.size(h), F.size(F.array_distinct(covered))).otherwise(0)
        return F.when(F.size(w) >= 4, let(windows, repeated)).otherwise(0)
    return let(words, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             stratum_col: str | None = "lang") -> DataFrame:
    """Base measures of each whole text; null texts have no words. A null
    stratum is the empty string."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), text.alias("text"))
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length("text")
    got = src.select(
        "id", "stratum",
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).cast("bigint").alias("r"))).alias("w"),
        (F.length(F.translate("text", WHITE_CHARS, "")).cast("bigint")).alias("word_chars"),
        (chars - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"))
    return got.select(
        "id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.d")).cast("bigint").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"), F.col("l.n").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 10."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) \
        + 1 / (1260 * y * y * y * y * y)
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return series - F.ln(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n p; 1 otherwise (such a k certifies nothing).

    The largest term in closed form times a sum of ratios, falling from k on.
    Terms further than ten standard deviations below are under 1e-20 of it."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) + k * F.ln(F.lit(p))
                + (n - k) * F.ln(F.lit(1 - p)))
    steps = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 200).cast("int")
    ratios = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, j: let(acc["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p),
                           lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s"))),
        lambda acc: acc["s"])
    return F.when(k < n * p, top * ratios).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality",
            risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``(stratum, symbols, dup_lines, repeats, word_length)``: the chosen
    cutoffs, null where none is certified. Labels other than 0 and 1 are not
    used; a document labelled twice counts twice."""
    labelled = measured.filter(~base_failed()).join(
        labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("good")).filter("good in (0, 1)"), "id")
    values = rule_values()
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
                 (values[rule] > c).alias("rejected"))
        for rule, grid in RULES.items() for i, c in enumerate(grid)])
    counts = labelled.select("stratum", "good", F.explode(tests).alias("t")).groupBy(
        "stratum", "t.rule", "t.step", "t.cutoff").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("n"),
        F.sum(F.when((F.col("good") == 1) & F.col("t.rejected"), 1).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("n_bad"),
        F.sum(F.when((F.col("good") == 0) & F.col("t.rejected"), 1).otherwise(0)).alias("k_bad"))
    limit = risk / len(RULES)
    # all rows below are strata x rules x cutoffs, however many documents
    strata = Window.partitionBy("rule", "step")
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    certified = counts.withColumn("p", binomial_tail(F.col("k"), F.col("n"), limit)) \
        .withColumn("level", F.lit(error / len(RULES)) / F.count("*").over(strata)) \
        .withColumn("worst", F.max("p").over(so_far)).filter(F.col("worst") <= F.col("level"))
    gain = F.coalesce(F.col("k_bad") / F.nullif(F.col("n_bad"), F.lit(0)), F.lit(0.0)) - F.col("k") / F.col("n")
    best = certified.groupBy("stratum", "rule").agg(
        F.max_by("cutoff", F.struct(gain.alias("g"), (-F.col("step")).alias("s"))).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def judged(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    values = rule_values()
    renamed = chosen.select(F.col("stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    if renamed.count() <= MAX_BROADCAST_STRATA:    # a row per stratum
        renamed = F.broadcast(renamed)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(values[r] > F.col(f"_{r}"), F.lit(False))
    return measured.join(renamed, "stratum", "left").withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
