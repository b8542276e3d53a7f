"""Statistics of weighted datasets: estimates of factors, moments, order statistics, information and error measures."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semifold.operators.dataset import with_row_index
from semifold.operators.factor import Factor
from semifold.operators.lineage import kept


def domain(spark_df: DataFrame, args: tuple[str, ...]) -> DataFrame:
    """All assignments of args: the product of the columns' distinct values, which are few by definition."""
    return reduce(DataFrame.crossJoin, [spark_df.select(a).where(F.col(a).isNotNull()).distinct() for a in args])


def counts(df: DataFrame, args: tuple[str, ...], weight: str | None = None, smoothing: float = 0.0) -> Factor:
    """Weighted counts over the whole domain, smoothing added to every cell."""
    w = F.col(weight) if weight else F.lit(1.0)
    seen = df.dropna(subset=list(args)).groupBy(*args).agg(F.sum(w).alias("value"))
    full = domain(df, args).join(seen, list(args), "left")
    return Factor(full.withColumn("value", F.coalesce("value", F.lit(0.0)) + smoothing), args)


def mle_marginal(df: DataFrame, args: tuple[str, ...], weight: str | None = None, smoothing: float = 0.0) -> Factor:
    return counts(df, args, weight, smoothing).normalize()


def mle_conditional(df: DataFrame, head: tuple[str, ...], tail: tuple[str, ...], weight: str | None = None, smoothing: float = 0.0) -> Factor:
    return counts(df, (*head, *tail), weight, smoothing).conditional(*tail)


def missing_policy(df: DataFrame, args: list[str], policy: str) -> DataFrame:
    """NO: rows as they are; SKIP: without rows that miss any of args; STRICT: an error if a row misses some, not all."""
    if policy == "NO":
        return df
    missing = reduce(lambda a, b: a + b, [F.col(a).isNull().cast("int") for a in args])
    if policy == "STRICT":
        bad = (missing > 0) & (missing < len(args))
        df = df.withColumn("_strict", F.when(bad, F.raise_error(F.lit("a row misses some of the arguments"))).otherwise(F.lit(1))).where(F.col("_strict") == 1).drop("_strict")
    return df.where(missing == 0)


def moments(df: DataFrame, columns: list[str], weight: str | None = None, keys: tuple[str, ...] = (), smoothing: float = 0.0) -> DataFrame:
    """Gaussian estimate in one pass, for each key: weight, means and the population covariance in long form (i, j)."""
    w = F.col(weight) if weight else F.lit(1.0)
    first = [F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    second = [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"_p{i}_{j}") for i, j in pairs]
    one = df.groupBy(*keys).agg(F.sum(w).alias("weight"), *first, *second)
    cell = lambda i, j: (F.col(f"_p{i}_{j}") + (smoothing if i == j else 0.0)) / F.col("weight") - F.col(f"_s{i}") * F.col(f"_s{j}") / (F.col("weight") * F.col("weight"))
    rows = F.array(*(F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), (F.col(f"_s{i}") / F.col("weight")).alias("mean_i"), (F.col(f"_s{j}") / F.col("weight")).alias("mean_j"), cell(i, j).alias("cov")) for i, j in pairs))
    return one.select(*keys, "weight", F.inline(rows))


def expected_value(df: DataFrame, f: Column, weight: Column | None = None) -> DataFrame:
    """Weighted mean of f and its standard error by the population variance."""
    w = weight if weight is not None else F.lit(1.0)
    mean = F.sum(w * f) / F.sum(w)
    var = F.greatest(F.sum(w * f * f) / F.sum(w) - mean * mean, F.lit(0.0))
    return df.agg(mean.alias("mean"), F.sqrt(var / F.sum(w)).alias("stderr"))


def order_statistics(df: DataFrame, column: str, tie: str, keys: tuple[str, ...]) -> DataFrame:
    """Rank from 0 of each row's value within its key.

    Rows are range-sorted by key and value and numbered, so a key with most of the rows is spread over many tasks; a key's
    first number is then taken off."""
    indexed = kept(with_row_index(df, *keys, column, tie, name="_row"))
    starts = indexed.groupBy(*keys).agg(F.min("_row").alias("_first"))
    joined = indexed.join(starts, list(keys)) if keys else indexed.crossJoin(starts)
    return joined.withColumn("rank", (F.col("_row") - F.col("_first")).cast("int")).drop("_row", "_first")


def quantile_at(df: DataFrame, column: str, keys: tuple[str, ...], place) -> DataFrame:
    """For each key the value at a place (a Column of _n, the key's number of values) of the sorted values."""
    indexed = kept(with_row_index(df.select(*keys, column).where(F.col(column).isNotNull()), *keys, column, name="_row"))
    spans = indexed.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).withColumn("_row", (F.col("_first") + place).cast("long")).select("_row")
    return indexed.join(spans, "_row").select(*keys, F.col(column).alias("value"))


def upper_median(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """For each key the value at place floor(n / 2) of the sorted values."""
    return quantile_at(df, column, keys, F.floor(F.col("_n") / 2)).withColumnRenamed("value", "median")


def median_deviation(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """For each key the upper median and the upper median of the distances from it."""
    m = kept(upper_median(df, column, keys))
    far = (df.join(m, list(keys)) if keys else df.crossJoin(m)).withColumn("_far", F.abs(F.col(column) - F.col("median")))
    mad = upper_median(far, "_far", keys).withColumnRenamed("median", "mad")
    return m.join(mad, list(keys)) if keys else m.crossJoin(mad)


def generalized_mean(df: DataFrame, column: str, keys: tuple[str, ...], kind: str) -> DataFrame:
    """center and spread: mean and its standard error (MEAN), or median and median absolute deviation (MEDIAN)."""
    if kind == "MEDIAN":
        return median_deviation(df, column, keys).select(*keys, F.col("median").alias("center"), F.col("mad").alias("spread"))
    return accumulator(df, column, keys).select(*keys, F.col("mean").alias("center"), F.col("stderr").alias("spread"))


def soft_counts(df: DataFrame, args: tuple[str, ...], probabilities: dict[object, Column], weight: Column | None = None, name: str = "state") -> Factor:
    """Expected counts where one argument is known only as a distribution for each row: the estimator's soft update."""
    w = weight if weight is not None else F.lit(1.0)
    cells = F.inline(F.array(*(F.struct(F.lit(s).alias(name), (w * p).alias("value")) for s, p in probabilities.items())))
    return Factor(df.select(*args, cells).groupBy(*args, name).agg(F.sum("value").alias("value")), (*args, name))


def mean_covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    """mean_a, mean_b and the sample covariance (n - 1) of two columns."""
    return df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.covar_samp(a, b).alias("cov"))


def extremes(df: DataFrame, column: str, key: str, by: str) -> DataFrame:
    """least and most of a column, and the key of the row with the largest by (the smallest key on ties)."""
    return df.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.max_by(key, F.struct(by, -F.col(key))).alias("at_most"))


def errors(df: DataFrame, truth: str, predicted: str, kind: str) -> DataFrame:
    """Mean error: squared for reals (sse: their sum), 0/1 for labels, with its standard error."""
    x = (F.col(truth) != F.col(predicted)).cast("double") if kind == "finite" else (F.col(truth) - F.col(predicted)) ** 2
    return df.agg(F.avg(x).alias("mean"), (F.stddev_pop(x) / F.sqrt(F.count(x))).alias("stderr"), F.sum(x).alias("total"))


def label_accuracy(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """For each truth column, the share of rows whose predicted column agrees, and the share of rows where all agree."""
    same = {t: (F.col(t) == F.col(p)).cast("double") for t, p in pairs.items()}
    return df.agg(*(F.avg(c).alias(f"{t}_accuracy") for t, c in same.items()), F.avg(reduce(lambda a, b: a * b, same.values())).alias("all_accuracy"))


def result_set(df: DataFrame, keys: tuple[str, ...], measure: str) -> DataFrame:
    """Repeated results of one measure by parameter keys: mean and sample deviation (0 for one result)."""
    return df.groupBy(*keys).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.coalesce(F.stddev_samp(measure), F.lit(0.0)).alias("dev"))


def accumulator(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, stderr, min and max: fields that merge, so Spark combines them before the shuffle."""
    x = F.col(column)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_pop(x) / F.sqrt(F.count(x))).alias("stderr"), F.min(x).alias("least"), F.max(x).alias("most"))


def pairwise_information(df: DataFrame, columns: list[str], smoothing: float = 0.0) -> DataFrame:
    """Mutual information of every pair of columns (a, b, mi), all pairs from one scan.

    Each row gives its cell of every pair to one combining group-by, so what is shuffled are cells of pairs, not of the
    full joint. Smoothing is added to every cell of a pair's domain (the values of a times those of b), seen or not.
    """
    pairs = list(combinations(columns, 2))
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs)))
    seen = kept(df.select(at.alias("p")).where("p.x is not null and p.y is not null").groupBy("p.a", "p.b", "p.x", "p.y").agg(F.count("*").cast("double").alias("n")))
    rows, columns_ = seen.groupBy("a", "b", "x").agg(F.sum("n").alias("nx")), seen.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    if smoothing:
        full = rows.join(columns_, ["a", "b"]).select("a", "b", "x", "y")
        cells = full.join(seen, ["a", "b", "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + smoothing)
        rows, columns_ = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("nx")), cells.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    else:
        cells = seen
    total = rows.groupBy("a", "b").agg(F.sum("nx").alias("t"))
    joint = cells.join(rows, ["a", "b", "x"]).join(columns_, ["a", "b", "y"]).join(total, ["a", "b"])
    return joint.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def precision_recall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """For each class: precision and recall (0 where undefined), from one group-by of class pairs."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = pairs.select(F.inline(F.array(F.struct(F.col("t").alias("label"), (F.col("t") == F.col("p")).cast("int").alias("hit"), F.lit(1).alias("actual"), F.lit(0).alias("said"), "n"), F.struct(F.col("p").alias("label"), F.lit(0).alias("hit"), F.lit(0).alias("actual"), F.lit(1).alias("said"), "n"))))
    total = each.groupBy("label").agg(*(F.sum(F.col(c) * F.col("n")).alias(c) for c in ("hit", "actual", "said")))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(0.0)
    return total.select("label", ratio("said").alias("precision"), ratio("actual").alias("recall"))
