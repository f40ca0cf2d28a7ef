"""Quality rules: base limits, then robust multivariate outliers by language and source.

Statistics of a text become a vector of smoothed log ratios. For every language and source a
minimum-covariance-determinant estimate gives centre and spread of the most central three quarters
of the vectors; a text whose Mahalanobis distance is beyond a chi-square quantile is rejected.

Vectors are whole numbers (256 to a unit), so that sums do not depend on the order of rows. A
concentration step is one aggregation: moments per group and distance bin, then running counts
over the bins of a group tell which of them make up the central part.

Cases: null and empty texts have no words and fail the base limits; a null language or source is a
value of its own; groups with fewer than ``least`` texts are pooled by language, then all together,
and a pool that is still smaller rejects nothing; repeated rows count as often as they occur; an
empty table gives an empty result; other input columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import let, words
from talkframe.session import cut

GRAM = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

UNIT = 256
#: Statistic and the noise of counting that is added to its spread, in log units. Rates that are
#: nought in most texts have no spread of their own, and the estimate must stay invertible; what is
#: ordinary is left to the spread. About four symbols in 750 characters, one repeated line in 24.
FLOORS = {"word_length": 0.12, "symbol_rate": 0.2, "line_rate": 0.3, "repeat_rate": 0.3, "length": 0.2}
DIMS = len(FLOORS)
CENTRAL = 0.75
STEPS = 6
LEAST = 60
TAIL = 1e-6


def chi2_cdf(x: float, d: int) -> float:
    """Distribution of the chi-square with d degrees of freedom, by recursion on d."""
    if d == 1:
        return math.erf(math.sqrt(x / 2))
    if d == 2:
        return 1 - math.exp(-x / 2)
    return chi2_cdf(x, d - 2) - (x / 2) ** (d / 2 - 1) * math.exp(-x / 2) / math.gamma(d / 2)


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def repeated_words(found: Column) -> Column:
    """Words that lie in a window of five words which occurs twice or more in the text."""

    def grams(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        return F.when(F.size(h) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*[at(i, k) for k in range(GRAM)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get(p, i + 1) - x, F.lit(GRAM))).cast("bigint"))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
        again = F.filter(s, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
        return let(F.array_sort(F.transform(again, lambda x: x["i"])), covered)

    def count(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(ordered, twice))

    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: let(grams(h), count))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every text, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda x: F.translate(x, BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")
    found = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    ranged = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    rows = docs.select(
        "doc_id", "lang", "source", found.alias("_w"), ranged.alias("_l"),
        F.length(bare(text)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    return rows.select("doc_id", "lang", "source", "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics in whole units. Ratios are smoothed, as those of short texts vary by chance."""
    n = F.col("n_words")
    logs = {
        "word_length": F.log((F.col("word_chars") + 100) / (n + 20)),
        "symbol_rate": F.log(F.lit(0.02) + F.col("n_symbols") / (F.col("word_chars") + 100)),
        "line_rate": F.log(F.lit(0.1) + F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "repeat_rate": F.log(F.lit(0.05) + F.col("n_repeat_words") / (n + 20)),
        "length": F.log(n + 20),
    }
    return [F.round(logs[k] * UNIT).cast("bigint").alias(f"x{i}") for i, k in enumerate(FLOORS)]


def grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds the group a row is judged in: language and source, else the small ones of the language, else the rest."""
    sizes = rows.where(~F.col("base_failed")).groupBy("lang", "source").count()
    small = F.col("count") < least
    sizes = sizes.withColumn("_pool", F.sum(F.when(small, F.col("count")).otherwise(0)).over(Window.partitionBy("lang")))
    name = F.when(~small, F.struct(F.lit(0).alias("level"), "lang", "source"))
    name = name.when(F.col("_pool") >= least, F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")))
    name = name.otherwise(F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    sizes = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.to_json(name).alias("grp"))
    return rows.join(sizes, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def triangle(groups: DataFrame, inflate: float) -> DataFrame:
    """(grp, m0.., l00..): centre and Cholesky factor of the spread, from sums over a central part."""
    n = F.col("n")
    floors = [(f * UNIT) ** 2 for f in FLOORS.values()]
    groups = groups.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(DIMS)})
    cov = {(i, j): (F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * inflate for i, j in PAIRS}
    groups = groups.withColumns({f"c{i}{j}": cov[i, j] + (floors[i] if i == j else 0.0) for i, j in PAIRS})
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return groups.select("grp", "n", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS])


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance; null where a row has no estimate."""
    rows = rows.join(estimates.drop("n"), "grp", "left")
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    rows = rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMS)), F.col("z0") * F.col("z0")))
    return rows.drop(*[f"z{i}" for i in range(DIMS)], *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS])


def sums() -> list[Column]:
    x = lambda i: F.col(f"x{i}")
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(DIMS)], *[F.sum(x(i) * x(j)).alias(f"s{i}{j}") for i, j in PAIRS]]


def concentrate(rows: DataFrame, central: float) -> DataFrame:
    """Sums over the part of each group that has the smallest distances.

    Distances fall into bins of a sixteenth of a log unit, at most a few hundred to a group.
    Whole bins are taken until the part is reached.
    """
    bins = rows.withColumn("bin", F.least(F.floor(F.log1p("d2") * 16), F.lit(400)).cast("int")).groupBy("grp", "bin").agg(*sums())
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(Window.partitionBy("grp"))
    bins = bins.withColumns({"_before": before, "_all": every}).where(F.col("_before") < F.col("_all") * central)
    return bins.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS)], *[F.sum(f"s{i}{j}").alias(f"s{i}{j}") for i, j in PAIRS])


def estimates(rows: DataFrame, central: float = CENTRAL, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """Centre and spread of each group of (grp, x0..): medians first, concentration steps, one reweighting."""
    whole = [F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(DIMS)]
    start = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *whole).where(F.col("n") >= least)
    floors = [f * UNIT for f in FLOORS.values()]
    spread = [F.sqrt(F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, F.lit(2.0)) + floors[i] ** 2) for i in range(DIMS)]
    current = cut(start.select("grp", "n", *[F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(DIMS)], *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]))
    inflate = central / chi2_cdf(chi2_quantile(central, DIMS), DIMS + 2)
    for _ in range(steps):
        near = distances(rows, current).where(F.col("d2").isNotNull())
        current = cut(triangle(concentrate(near, central), inflate))
    near = distances(rows, current).where(F.col("d2") <= chi2_quantile(0.975, DIMS))
    return cut(triangle(near.groupBy("grp").agg(*sums()), 0.975 / chi2_cdf(chi2_quantile(0.975, DIMS), DIMS + 2)))


def judge(docs: DataFrame, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """Counts, base verdict, squared distance and verdict of every document."""
    rows = statistics(docs).withColumn("base_failed", base_failed())
    rows = cut(rows.select("*", *vector()))
    rows = grouped(rows, least)
    good = rows.where(~F.col("base_failed")).select("grp", *[f"x{i}" for i in range(DIMS)])
    judged = distances(rows, estimates(good, least=least))
    usual = F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, DIMS), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & usual).alias("kept"), F.col("d2").alias("distance"),
    )
