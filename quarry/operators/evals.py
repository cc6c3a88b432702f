"""Evaluation runs: summaries, scores, comparison of runs, diffs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import jaro_winkler

# Weights of the six dimensions, and pass marks.
WEIGHTS = (("file_precision", 0.15), ("file_recall", 0.15), ("logical_equivalence", 0.30), ("code_quality", 0.20), ("edge_case_handling", 0.10), ("approach_validity", 0.10))
PASS_MEAN, PASS_INVERTED = 3.0, 2.0
# Weights of the structural score, and its pass marks.
STRUCTURE, STRUCTURE_PASS, STRUCTURE_INVERTED = (0.30, 0.30, 0.40), 0.50, 0.35


def cases(results: DataFrame, suite: str, case: str, first: tuple[str, ...] = (), order: str = "run_index") -> DataFrame:
    """One row for each case: runs, mean score, spread (population), whether any run passed, cost, and columns `first` of its first run."""
    return results.groupBy(suite, case).agg(
        F.count("*").alias("runs"), F.avg("composite").alias("mean_composite"), F.coalesce(F.stddev_pop("composite"), F.lit(0.0)).alias("std_composite"),
        F.bool_or("passed").alias("passed"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), *[F.min_by(c, order).alias(c) for c in first],
    )


def totals(results: DataFrame, *by: str) -> DataFrame:
    """Tokens and cost, the cost as a decimal of six places, so sums are exact."""
    return results.groupBy(*by).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce(F.col("cost").cast("decimal(10,6)"), F.lit(0))).alias("cost"))


def dimensions(scores: DataFrame, run: str) -> DataFrame:
    """run, dimension, mean, spread (population) for each of the six dimensions; one without scores counts 0."""
    names = F.array(*[F.lit(n) for n, _ in WEIGHTS])
    every = scores.select(run).distinct().select(run, F.explode(names).alias("dimension"))
    found = scores.groupBy(run, "dimension").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return every.join(found, [run, "dimension"], "left").fillna(0.0, ["mean", "std"])


def suites(results: DataFrame, suite: str, case: str) -> DataFrame:
    """One row for each suite: pass rate over cases, mean and variance over all runs."""
    runs = results.groupBy(suite).agg(F.avg("composite").alias("mean_composite"), F.var_pop("composite").alias("var_composite"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"))
    per = cases(results, suite, case).groupBy(suite).agg(F.count("*").alias("cases"), F.sum(F.col("passed").cast("int")).alias("passing"))
    return runs.join(per, suite).withColumn("pass_rate", F.col("passing") / F.col("cases"))


def compare(before: DataFrame, now: DataFrame, case: str) -> DataFrame:
    """case, kind (regression, improvement, stable, new, removed) and delta of two tables of case, passed, mean_composite."""
    b = before.select(case, F.col("passed").alias("b"), F.col("mean_composite").alias("bm"))
    n = now.select(case, F.col("passed").alias("n"), F.col("mean_composite").alias("nm"))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("b") & ~F.col("n"), "regression").when(~F.col("b") & F.col("n"), "improvement").otherwise("stable")
    return b.join(n, case, "full_outer").select(case, kind.alias("kind"), (F.col("nm") - F.col("bm")).alias("delta"))


def weighted(scores: dict[str, Column]) -> Column:
    """The weighted composite of named dimension scores; an absent one counts 0."""
    out = F.lit(0.0)
    for name, w in WEIGHTS:
        if name in scores:
            out = out + F.lit(w) * F.coalesce(scores[name], F.lit(0.0))
    return out


def passes(mean: Column, inverted: Column) -> Column:
    return F.when(inverted, mean < PASS_INVERTED).otherwise(mean >= PASS_MEAN)


def structure(precision: Column, recall: Column, lines: Column) -> Column:
    """The composite of file precision, file recall and line similarity, as a decimal of parts with six places: so a score that stands on a mark is on it."""
    weighted = [F.lit(Decimal(str(w))) * x.cast("decimal(12,6)") for w, x in zip(STRUCTURE, (precision, recall, lines))]
    return weighted[0] + weighted[1] + weighted[2]


def structure_passes(score: Column, inverted: Column) -> Column:
    low, mark = (F.lit(Decimal(str(x))) for x in (STRUCTURE_INVERTED, STRUCTURE_PASS))
    return F.when(inverted, score < low).otherwise(score >= mark)


def advisory(rate: Column) -> Column:
    return F.when(rate >= 0.8, "pass").when(rate >= 0.5, "warning").otherwise("fail")


def overlap(expected: Column, actual: Column) -> tuple[Column, Column]:
    """Precision and recall of two sets; 0 where the denominator is empty."""
    both = F.size(F.array_intersect(expected, actual))
    def share(c):
        n = F.size(F.array_distinct(c))
        return F.when(n > 0, both / n).otherwise(0.0)
    return share(actual), share(expected)


def eta(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Items a second, and seconds left; null without a total or under 0.001 a second."""
    rate = F.when(seconds > 0, done / seconds).otherwise(0.0)
    return rate, F.when((total > 0) & (rate >= 0.001), (total - done) / rate)


def diff_files(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """key, path, hunks, lines_added, lines_removed and added (the added lines, in order) of each file of a unified diff.

    A file begins at its `diff --git` line and bears the name behind the last
    ` b/`; lines before the first hunk and lines that begin with `--- ` or `+++ `
    count nothing.  An empty diff has no files.
    """
    files = patches.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), patch), r"\r?\ndiff --git ")).alias("i", "part")).where("i > 0")
    lines = F.split("part", r"\r?\n")
    start = F.array_position(F.transform(lines, lambda x: x.startswith("@@ ")), F.lit(True))  # 0 if there is no hunk
    hunk = F.when(start > 0, F.filter(F.slice(lines, start, F.size(lines)), lambda x: ~x.startswith("--- ") & ~x.startswith("+++ "))).otherwise(F.slice(lines, 1, 0))
    head = F.get(lines, F.lit(0))
    path = F.when(head.contains(" b/"), F.regexp_extract(head, r"^.* b/(.*)$", 1)).otherwise(F.substring_index(head, " ", -1))
    marked = lambda p: F.filter(hunk, lambda x: x.startswith(p))
    added = F.transform(marked("+"), lambda x: F.regexp_replace(x, r"^\++", ""))
    return files.select(key, path.alias("path"), F.size(marked("@@ ")).alias("hunks"), F.size(marked("+")).alias("lines_added"), F.size(marked("-")).alias("lines_removed"), added.alias("added"))


def compare_diffs(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, file_precision, file_recall, line_similarity, other_files of two tables of diff_files().

    Lines of a file that both have are paired by position; its similarity is the
    sum of theirs over the longer list, 1 if neither adds lines.  The mean is over
    shared files in `.rs`, 0 without any; the names of all others are listed.
    """
    def of(df, name):
        return df.groupBy(key, "path").agg(F.flatten(F.collect_list("added")).alias(name))

    both = of(expected, "e").join(of(actual, "a"), [key, "path"], "full_outer")
    rust = F.col("path").endswith(".rs")
    shared = both.where(rust & F.col("e").isNotNull() & F.col("a").isNotNull())
    longest = F.greatest(F.size("e"), F.size("a"))
    pairs = shared.select(key, "path", longest.alias("most"), F.explode_outer(F.slice(F.arrays_zip("e", "a"), F.lit(1), F.least(F.size("e"), F.size("a")))).alias("p"))
    alike = pairs.groupBy(key, "path").agg(F.first("most").alias("most"), F.sum(jaro_winkler("p.e", "p.a")).alias("s"))
    alike = alike.withColumn("one", F.when(F.col("most") == 0, 1.0).otherwise(F.coalesce("s", F.lit(0.0)) / F.col("most")))
    lines = alike.groupBy(key).agg(F.avg("one").alias("line_similarity"))
    n_e, n_a, n_both = F.count("e"), F.count("a"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull())
    files = both.groupBy(key).agg(
        F.when(n_a > 0, n_both / n_a).otherwise(0.0).alias("file_precision"), F.when(n_e > 0, n_both / n_e).otherwise(0.0).alias("file_recall"),
        F.array_sort(F.collect_set(F.when(~rust, F.col("path")))).alias("other_files"),
    )
    return files.join(lines, key, "left").fillna(0.0, ["line_similarity"])
