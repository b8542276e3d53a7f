"""Learning from DataFrames: each step is an aggregate of sufficient statistics; only those reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semifold.functions.scalar import logistic
from semifold.operators.dataset import sliding
from semifold.operators.factor import Factor
from semifold.operators.lineage import dropped, kept
from semifold.operators.optimize import Options, minimise
from semifold.operators.statistics import mle_conditional, mle_marginal, pairwise_information


@dataclass
class NaiveBayes:
    """prior over label and one conditional factor for each feature."""

    label: str
    prior: Factor
    features: dict[str, Factor]

    @classmethod
    def fit(cls, df: DataFrame, label: str, features: list[str], smoothing: float = 0.0) -> NaiveBayes:
        return cls(label, mle_marginal(df, (label,), smoothing=smoothing), {f: mle_conditional(df, (f,), (label,), smoothing=smoothing) for f in features})

    def _scores(self, df: DataFrame) -> tuple[DataFrame, list, Column]:
        """df with one array of class scores for each feature, the classes, and the array of their log joints.

        Rows meet a feature's table, one row for each of its values, once; classes, few by definition, lie in arrays."""
        prior = {r[self.label]: r["value"] for r in self.prior.df.collect()}
        classes = sorted(prior)
        total = F.array(*(F.lit(float(np.log(prior[c])) if prior[c] > 0 else float("-inf")) for c in classes))
        for name, factor in self.features.items():
            score = F.array(*(F.coalesce(F.max(F.when(F.col(self.label) == F.lit(c), F.ln("value"))), F.lit(float("-inf"))) for c in classes))
            df = df.join(factor.df.groupBy(name).agg(score.alias(f"_s_{name}")), name, "left")
            total = F.zip_with(total, F.coalesce(f"_s_{name}", F.array(*[F.lit(0.0)] * len(classes))), lambda x, y: x + y)
        return df, classes, total

    def posterior(self, df: DataFrame, key: str) -> DataFrame:
        """key, label and its probability; a missing or unknown feature value says nothing."""
        rows, classes, total = self._scores(df.select(key, *self.features))
        rows = rows.select(key, total.alias("_l"))
        p = F.transform("_l", lambda x: F.exp(x - F.array_max("_l")))
        each = F.inline(F.arrays_zip(F.array(*map(F.lit, classes)).alias("label"), F.col("_p").alias("p")))
        z = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)
        return rows.select(key, p.alias("_p")).select(key, z.alias("_z"), each).select(key, F.col("label").alias(self.label), (F.col("p") / F.col("_z")).alias("probability"))

    def likelihoods(self, df: DataFrame) -> DataFrame:
        """One row: log_likelihood of labels and features, conditional (of labels given features), and accuracy of the
        likeliest label (the smallest on ties)."""
        rows, classes, total = self._scores(df.select(self.label, *self.features))
        rows = rows.select(self.label, total.alias("_l"))
        own = F.get("_l", F.array_position(F.array(*map(F.lit, classes)), F.col(self.label)).cast("int") - 1)
        top = F.array_max("_l")
        all_ = top + F.ln(F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
        best = F.get(F.array(*map(F.lit, classes)), F.array_position("_l", top).cast("int") - 1)
        return rows.agg(F.sum(own).alias("log_likelihood"), F.sum(own - all_).alias("conditional"), F.avg((best == F.col(self.label)).cast("double")).alias("accuracy"))


def naive_bayes_em(df: DataFrame, features: list[str], weights: dict[str, list[float]], rounds: int) -> DataFrame:
    """EM for a hidden class with the given start: weights holds a start weight of each class for the first feature's values,
    by value. Returns (class, feature, value, probability) and the class weights as feature ''.

    A round is one group-by of (rows x classes) expected counts; the tables of parameters are joined back by value."""
    n = len(next(iter(weights.values())))
    start = F.create_map(*(x for v, w in weights.items() for x in (F.lit(v), F.array(*(F.lit(float(c) / sum(w)) for c in w)))))
    cells = kept(df.dropna(subset=features).groupBy(*features).agg(F.count("*").cast("double").alias("_n")))  # rows of one kind count once
    resp = cells.withColumn("_p", F.coalesce(F.element_at(start, F.col(features[0])), F.array(*[F.lit(1.0 / n)] * n)))
    out = None
    for _ in range(rounds):
        each = resp.select(*features, "_n", F.posexplode("_p").alias("class", "_w")).withColumn("_w", F.col("_w") * F.col("_n"))
        long = each.select("class", "_w", F.inline(F.array(F.struct(F.lit("").alias("feature"), F.lit("").alias("value")), *(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))))
        sums = long.groupBy("class", "feature", "value").agg(F.sum("_w").alias("_w"))
        total = sums.groupBy("class").agg(F.sum(F.when(F.col("feature") == "", F.col("_w"))).alias("_t"))
        whole = total.agg(F.sum("_t").alias("_a"))
        out = kept(sums.join(total, "class").crossJoin(whole).select("class", "feature", "value", (F.col("_w") / F.when(F.col("feature") == "", F.col("_a")).otherwise(F.col("_t"))).alias("probability")))
        logs = out.where("feature <> ''").groupBy("feature", "value").agg(F.array(*(F.coalesce(F.max(F.when(F.col("class") == k, F.ln("probability"))), F.lit(float("-inf"))) for k in range(n))).alias("_l"))
        prior = {r["class"]: r["probability"] for r in out.where("feature = ''").collect()}
        rows, score = cells, F.array(*(F.lit(float(np.log(max(prior.get(k, 0.0), 1e-300)))) for k in range(n)))
        for f in features:
            rows = rows.join(logs.where(F.col("feature") == f).select(F.col("value").alias(f"_v_{f}"), F.col("_l").alias(f"_l_{f}")), F.col(f).cast("string") == F.col(f"_v_{f}")).drop(f"_v_{f}")
            score = F.zip_with(score, f"_l_{f}", lambda x, y: x + y)
        e = rows.select(*features, "_n", score.alias("_s")).withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
        resp = kept(e.select(*features, "_n", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda s, y: s + y)).alias("_p")))
    return out


def markov_chain(df: DataFrame, seq: str, t: str, state: str, smoothing: float = 0.0) -> tuple[Factor, Factor]:
    """Initial distribution and transition factor p(next | current) of sequences."""
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(seq).orderBy(t))).where(F.col("_k") == 1)
    steps = sliding(df, seq, t, [state], 1).select(F.col(f"{state}__0").alias("current"), F.col(f"{state}__1").alias("next"))
    return mle_marginal(first, (state,), smoothing=smoothing), mle_conditional(steps, ("next",), ("current",), smoothing=smoothing)


def markov_log_likelihood(df: DataFrame, seq: str, t: str, state: str, initial: Factor, step: Factor) -> DataFrame:
    """One row: log probability of all sequences under the chain."""
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(seq).orderBy(t))).where(F.col("_k") == 1)
    pairs = sliding(df, seq, t, [state], 1).select(F.col(f"{state}__0").alias("current"), F.col(f"{state}__1").alias("next"))
    return initial.log_likelihood(first).unionAll(step.log_likelihood(pairs)).agg(F.sum("value").alias("value"))


def chow_liu(df: DataFrame, columns: list[str], smoothing: float = 0.0) -> DataFrame:
    """Edges (src, dst, mi) of the tree of largest total mutual information. Pairs of columns are metadata, so the tree is
    taken on the driver by Kruskal's rule, ties by name."""
    pairs = sorted(((-r["mi"], r["a"], r["b"]) for r in pairwise_information(df, columns, smoothing).collect()))
    root, chosen = {c: c for c in columns}, []

    def top(c: str) -> str:
        while root[c] != c:
            c = root[c]
        return c

    for mi, a, b in pairs:
        if top(a) != top(b):
            root[top(a)] = top(b)
            chosen.append((a, b, -mi))
    return df.sparkSession.createDataFrame(chosen, "src string, dst string, mi double")


def best_elastic(gram: np.ndarray, target: np.ndarray, n: float, l1: float, l2: float, steps: int = 2000) -> np.ndarray:
    """Minimiser of the quadratic with penalties, the first component free: shrinkage steps with momentum (FISTA)."""
    rate = 1.0 / (np.linalg.eigvalsh(gram / n)[-1] + l2)
    beta = z = np.zeros(len(target))
    t = 1.0
    for _ in range(steps):
        g = (gram @ z - target) / n + l2 * np.array([0.0, *z[1:]])
        new = z - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * l1, 0.0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, done = new + (t - 1) / s * (new - beta), np.abs(new - beta).max() < 1e-12
        beta, t = new, s
        if done:
            break
    return beta


def penalised_regression(df: DataFrame, features: list[str], target: str, l1: float = 0.0, l2: float = 0.0) -> dict[str, float]:
    """Elastic-net least squares over standardised features from one aggregate of all products; coefficients are given back
    on the features' own scale."""
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    k = len(columns)
    row = df.agg(*(F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k))).first()
    m = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:-1] / n
    sd = np.sqrt(np.maximum(np.diag(m)[1:-1] / n - mean**2, 1e-300))
    a = np.zeros((k - 1, k - 1))  # from standardised to raw rows: x = a' r
    a[0, 0] = 1.0
    for i in range(1, k - 1):
        a[i, i], a[i, 0] = 1 / sd[i - 1], -mean[i - 1] / sd[i - 1]
    beta = best_elastic(a @ m[:-1, :-1] @ a.T, a @ m[:-1, -1], n, l1, l2) @ a
    return dict(zip(["intercept", *features], beta.tolist(), strict=True))


def multiclass_logistic(df: DataFrame, features: list[str], label: str, method: str = "lbfgs", l2: float = 0.0, options: Options = Options()) -> tuple[list, np.ndarray]:
    """Classes and coefficients (class x intercept and features) of multinomial logistic regression. Value and gradient are
    one aggregate for each evaluation; features should be of like scale."""
    rows = kept(df.select(F.col(label).alias("_y"), *(F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features))).dropna())
    classes = [r[0] for r in rows.groupBy("_y").count().orderBy("_y").select("_y").collect()]
    x = [F.lit(1.0), *(F.col(f"_x{k}") for k in range(len(features)))]
    n, shape = rows.count(), (len(classes), len(x))

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        b = theta.reshape(shape)
        score = [sum((F.lit(float(c)) * v for c, v in zip(row[1:], x[1:], strict=True)), F.lit(float(row[0]))) for row in b]
        s = rows.withColumn("_s", F.array(*score)).withColumn("_m", F.array_max("_s"))
        s = s.withColumn("_e", F.transform("_s", lambda v: F.exp(v - F.col("_m")))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda t, v: t + v))
        hit = [(F.col("_y") == F.lit(c)).cast("double") for c in classes]
        loss = F.col("_m") + F.ln("_z") - sum((h * F.get("_s", F.lit(k)) for k, h in enumerate(hit)), F.lit(0.0))
        grads = [F.sum((F.get("_e", F.lit(k)) / F.col("_z") - h) * v).alias(f"g{k}_{j}") for k, h in enumerate(hit) for j, v in enumerate(x)]
        r = s.agg(F.sum(loss).alias("loss"), *grads).first()
        g = np.array([[r[f"g{k}_{j}"] for j in range(shape[1])] for k in range(shape[0])]) / n + l2 * b
        return r["loss"] / n + l2 / 2 * float((b**2).sum()), g.ravel()

    return classes, minimise(objective, np.zeros(shape[0] * shape[1]), method, options).reshape(shape)


def mixture_em(df: DataFrame, columns: list[str], means: list[list[float]], rounds: int) -> list[dict]:
    """EM for a mixture of Gaussians in any dimension from given means and the shared sample covariance: a round is one
    aggregate of expected sums. Rows that miss a column are left out."""
    x = [F.col(c).cast("double") for c in columns]
    rows, d = df.dropna(subset=columns), len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    first = rows.agg(F.count("*").alias("n"), *(F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.array([[first[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]) + 1e-9 * np.eye(d)
    parts = [{"weight": 1 / len(means), "mean": np.array(m, float), "cov": cov.copy()} for m in means]
    for _ in range(rounds):
        logs = []
        for q in parts:
            inv, det = np.linalg.inv(q["cov"]), np.linalg.slogdet(q["cov"])[1]
            diff = [c - float(m) for c, m in zip(x, q["mean"], strict=True)]
            square = sum((float(inv[i, j]) * diff[i] * diff[j] for i in range(d) for j in range(d)), F.lit(0.0))
            logs.append(F.lit(float(np.log(max(q["weight"], 1e-300)) - det / 2)) - square / 2)
        p = rows.select(*(c.alias(f"_x{k}") for k, c in enumerate(x)), F.array(*logs).alias("_l"))
        p = p.withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.array_max("_l")))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda s, v: s + v))
        w = [F.get("_e", F.lit(k)) / F.col("_z") for k in range(len(parts))]
        y = [F.col(f"_x{k}") for k in range(d)]
        aggs = [a for k in range(len(parts)) for a in (F.sum(w[k]).alias(f"w{k}"), *(F.sum(w[k] * y[i]).alias(f"m{k}_{i}") for i in range(d)), *(F.sum(w[k] * y[i] * y[j]).alias(f"s{k}_{i}_{j}") for i, j in pairs))]
        r = p.agg(F.count("*").alias("n"), *aggs).first()
        for k, q in enumerate(parts):
            t = max(r[f"w{k}"] or 0.0, 1e-12)
            q["weight"], q["mean"] = t / max(r["n"], 1), np.array([r[f"m{k}_{i}"] or 0.0 for i in range(d)]) / t
            q["cov"] = np.array([[(r[f"s{k}_{min(i, j)}_{max(i, j)}"] or 0.0) / t for j in range(d)] for i in range(d)]) - np.outer(q["mean"], q["mean"]) + 1e-9 * np.eye(d)
    return parts


def grid(axes: dict[str, tuple[float, float]], steps: int, log: bool = False) -> list[dict[str, float]]:
    """All combinations of evenly spaced values of each parameter, on a linear or a log scale."""
    points: list[dict[str, float]] = [{}]
    for name, (lo, hi) in axes.items():
        values = np.geomspace(lo, hi, steps) if log else np.linspace(lo, hi, steps)
        points = [{**p, name: float(v)} for p in points for v in values]
    return points


def zoomed(axes: dict[str, tuple[float, float]], best: dict[str, float], steps: int, log: bool = False) -> dict[str, tuple[float, float]]:
    """The axes one step around the best point: the next, finer grid."""
    out = {}
    for name, (lo, hi) in axes.items():
        k = (hi / lo) ** (1 / (steps - 1)) if log else (hi - lo) / (steps - 1)
        out[name] = (max(lo, best[name] / k), min(hi, best[name] * k)) if log else (max(lo, best[name] - k), min(hi, best[name] + k))
    return out


def cross_validated(df: DataFrame, folds: int, points: list[dict[str, float]], fit, score, column: str = "fold") -> list[dict[str, float]]:
    """For each parameter point the mean and the deviation of score(model, held-out rows) over the folds of a column. fit
    takes (rows, **point); score returns a one-row DataFrame with value, larger being better. Rows are computed once, not
    for every point and fold."""
    out, df = [], kept(df)
    for point in points:
        values = [score(fit(df.where(F.col(column) != k), **point), df.where(F.col(column) == k)).first()["value"] for k in range(folds)]
        out.append({**point, "mean": float(np.mean(values)), "dev": float(np.std(values))})
    dropped(df)
    return out


def best_by_zoom(df: DataFrame, folds: int, axes: dict[str, tuple[float, float]], steps: int, zooms: int, fit, score, log: bool = False) -> dict[str, float]:
    """Cross-validation over a grid, then over finer grids around the best point; the best point with its mean."""
    best: dict[str, float] = {}
    for _ in range(zooms + 1):
        found = max(cross_validated(df, folds, grid(axes, steps, log), fit, score), key=lambda p: p["mean"])
        best = found if not best or found["mean"] > best["mean"] else best
        axes = zoomed(axes, best, steps, log)
    return best


def linear_regression(df: DataFrame, features: list[str], target: str, l2: float = 0.0, weight: str | None = None) -> dict[str, float]:
    """Least squares by the normal equations: one aggregate of all products, solved on the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    n = len(columns)
    row = df.agg(*(F.sum(w * columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n))).first()
    m = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    a = m[:-1, :-1] + l2 * np.diag([0.0, *np.ones(n - 2)])
    beta = np.linalg.lstsq(a, m[:-1, -1], rcond=None)[0]
    return dict(zip(["intercept", *features], beta.tolist(), strict=True))


def logistic_regression(df: DataFrame, features: list[str], label: str, steps: int = 25, l2: float = 1e-3) -> dict[str, float]:
    """Binary logistic regression by Newton steps: gradient and Hessian are one aggregate a step."""
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    beta = np.zeros(len(x))
    for _ in range(steps):
        p = logistic(sum((float(b) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0]))))
        g = [F.sum((F.col(label) - p) * c).alias(f"g{i}") for i, c in enumerate(x)]
        h = [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
        r = df.agg(F.count("*").alias("n"), *g, *h).first()
        n = max(r["n"], 1)
        grad = np.array([r[f"g{i}"] or 0.0 for i in range(len(x))]) / n - l2 * beta
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))]) / n + l2 * np.eye(len(x))
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(["intercept", *features], beta.tolist(), strict=True))


def linear_prediction(coefficients: dict[str, float]) -> Column:
    return sum((F.lit(b) * F.col(f) for f, b in coefficients.items() if f != "intercept"), F.lit(coefficients["intercept"]))


def gaussian_mixture_1d(df: DataFrame, column: str, means: list[float], rounds: int) -> list[dict[str, float]]:
    """EM for a mixture of one-dimensional Gaussians from given means: each round is one aggregate."""
    x = F.col(column).cast("double")
    s = df.agg(F.stddev_pop(x)).first()[0] or 1.0
    parts = [{"weight": 1 / len(means), "mean": float(m), "sd": float(s)} for m in means]
    for _ in range(rounds):
        logs = [F.lit(float(np.log(max(p["weight"], 1e-300)) - np.log(p["sd"]))) - (x - p["mean"]) ** 2 / (2 * p["sd"] ** 2) for p in parts]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        e = [F.exp(v - top) for v in logs]
        z = sum(e[1:], e[0])
        aggs = [f(v / z).alias(f"{n}{k}") for k, v in enumerate(e) for n, f in (("w", F.sum), ("m", lambda r: F.sum(r * x)), ("q", lambda r: F.sum(r * x * x)))]
        r = df.where(x.isNotNull()).agg(F.count("*").alias("n"), *aggs).first()
        for k, p in enumerate(parts):
            w = max(r[f"w{k}"] or 0.0, 1e-12)
            p["weight"], p["mean"] = w / max(r["n"], 1), r[f"m{k}"] / w
            p["sd"] = float(np.sqrt(max(r[f"q{k}"] / w - p["mean"] ** 2, 1e-12)))
    return parts


def proportional_fitting(joint: Factor, targets: list[Factor], rounds: int, tolerance: float = 0.0) -> Factor:
    """Iterative proportional fitting: joint times target over marginal, for each target in turn, until no marginal is
    further from its target than tolerance. Each round is stored, so plans do not grow with the rounds."""
    fitted = joint
    for _ in range(rounds):
        for target in targets:
            fitted = (fitted * (target / fitted.marginal(*target.args))).reorder(*joint.args)
        if rounds == 1:
            return fitted
        fitted = Factor(kept(fitted.df), fitted.args)
        if max((t.norm_inf(fitted.marginal(*t.args)).first()["value"] or 0.0) for t in targets) <= tolerance:
            break
    return fitted
