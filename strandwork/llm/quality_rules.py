"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule rejects a text whose measure passes a cutoff. For each stratum (language)
the cutoff is chosen on labelled good texts: from lenient to strict, a cutoff holds
while the exact (Clopper-Pearson) upper bound of its false-rejection rate stays at or
below the rule's share of the allowed risk; the first that doesn't hold ends the
sequence. Fixed-sequence testing needs no correction within a rule and stratum; over
rules and strata the error probability is split (Bonferroni).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.support import whole_text, words_of, written

WINDOW = 8


@dataclass(frozen=True)
class QualityRule:
    """Rejects where the measure is over (or under, if below) the cutoff; cutoffs run from lenient to strict."""

    name: str
    cutoffs: tuple[float, ...]
    below: bool = False

    def rejects(self, cutoff: float | Column) -> Column:
        return F.col(self.name) < cutoff if self.below else F.col(self.name) > cutoff


RULES = (
    QualityRule("symbol_ratio", (0.8, 0.5, 0.3, 0.2, 0.1, 0.05)),
    QualityRule("dup_line_ratio", (0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    QualityRule("repeat_ratio", (0.5, 0.3, 0.2, 0.1, 0.05)),
    QualityRule("distinct_ratio", (0.05, 0.1, 0.2, 0.3, 0.4), below=True),
    QualityRule("upper_ratio", (0.8, 0.6, 0.4, 0.2, 0.1)),
    QualityRule("mean_word_chars", (40.0, 20.0, 15.0, 12.0, 10.0)),
)


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' measures.

    Null text counts as empty; all counts of an empty text are 0 and so are its ratios
    (distinct_ratio: 1). One row comes out for each row in, whatever repeats.
    """
    t = F.col("__text")
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    df = docs.select(*keep, whole_text(text).alias("__text"))
    df = df.select(
        *keep,
        words_of(t).alias("__words"),
        F.filter(F.split(t, "\n"), has_word).alias("__lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[A-Z]", ""))).cast("long").alias("__upper"),
    )
    df = df.select(
        *keep, "n_symbols", "__upper",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("__words")).cast("long").alias("__distinct"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    windows = F.when(F.size("__hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW))))
    df = df.withColumn("__windows", windows).drop("__hashes")
    # most texts repeat no window; only the others are sorted
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumn("__sorted", F.when(repeats, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    near = lambda s, j, d: F.coalesce(F.get("__sorted", j + d)["h"] == s["h"], F.lit(False))
    twice = F.filter("__sorted", lambda s, j: near(s, j, -1) | near(s, j, 1))
    df = df.withColumn("__starts", F.array_sort(F.transform(twice, lambda s: s["i"]))).drop("__sorted")
    steps = F.transform("__starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", j + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("__starts")
    per = lambda a, b, empty=0.0: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_dup_lines", "__n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("__distinct", "n_words", 1.0).alias("distinct_ratio"),
        per("__upper", "word_chars").alias("upper_ratio"),
        per("word_chars", "n_words").alias("mean_word_chars"),
    )


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series shifted to arguments of 20 or more, to about 1e-14."""
    x = n.cast("double")
    series = lambda y: y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series(x))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k], exact to double precision: terms from k down until they no longer count.

    For k at or over n*p the value is only used as "large", so 1 stands for it.
    """
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratio = lambda j: j / (n - j + 1) * ((1 - p) / p)
    # below the mean the terms fall at least as fast as a normal curve: 40 deviations are beyond any double
    terms = F.least(k, (40 * F.sqrt(k.cast("double")) + 50).cast("long"))
    step = lambda a, i: F.struct((a["term"] * ratio(k - i)).alias("term"), (a["total"] + a["term"] * ratio(k - i)).alias("total"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), terms - 1), start, step, lambda a: a["total"])).otherwise(F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first + F.log(total)))


def choose_cutoffs(holdout: DataFrame, stratum: str, rules=RULES, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, rule, level): how many cutoffs of each rule hold on the labelled good rows of holdout.

    With probability 1 - error, in every stratum all rules together reject at most the
    share risk of good texts. Strata without good rows have no row here.
    """
    share = risk / len(rules)
    counts = [F.sum(F.coalesce(r.rejects(c), F.lit(False)).cast("long")).alias(f"__{r.name}_{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    by = holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *counts)
    tests = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.col(f"__{r.name}_{i}").alias("k")) for r in rules for i in range(len(r.cutoffs))])
    strata = by.agg(F.count(F.lit(1)).alias("strata"))
    by = by.select(stratum, "n", F.explode(tests).alias("t")).select(stratum, "n", "t.rule", "t.step", "t.k").crossJoin(strata)
    holds = binomial_tail(F.col("k"), F.col("n"), share) <= F.lit(error) / (F.lit(len(rules)) * F.col("strata"))
    in_order = Window.partitionBy(stratum, "rule").orderBy("step")
    by = by.withColumn("holds", F.min(holds.cast("int")).over(in_order))
    return by.groupBy(stratum, "rule").agg(F.sum("holds").cast("int").alias("level"))


def judge_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", stratum: str = "lang",
    rules=RULES, risk: float = 0.05, error: float = 0.05, min_words: int = 20, max_repeat_percent: int = 30,
) -> DataFrame:
    """Per row of docs: its counts, base_failed, rejected_by (array of rule names) and kept.

    Good rows are those that labels marks with quality 1 in all their label rows; null ids
    or labels count as unlabelled. A null stratum is a stratum of its own. Empty docs or
    labels: no cutoff holds, so only the base rules judge. Texts are read once; the counts
    are written to the shared folder and both the choice of cutoffs and the verdict use them.
    """
    measured = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__stratum"), F.col(text).alias("__t"))
    measured = written(measure(measured, ["__id", "__stratum"], "__t"), "measures")
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    levels = choose_cutoffs(measured.join(good.select("__id"), "__id"), "__stratum", rules, risk, error)
    levels = levels.groupBy("__stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("__levels"))
    out = measured.join(levels, "__stratum", "left")
    fails = []
    for r in rules:
        level = F.coalesce(F.col("__levels")[r.name], F.lit(0))
        cutoff = F.get(F.array(*map(F.lit, r.cutoffs)), level - 1)
        fails.append(F.when((level > 0) & r.rejects(cutoff), F.lit(r.name)))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("rejected_by", F.array_compact(F.array(*fails))).withColumn("base_failed", base_failed)
    return out.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by",
    )
