"""Stateful operators over streams: incremental counts, windowed counts with late data, and a recursive Bayes filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def incremental_counts(stream: DataFrame, args: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Weighted counts of assignments so far (output mode complete): the incremental estimator's statistics."""
    return stream.groupBy(*args).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("value"))


def windowed_counts(stream: DataFrame, ts: str, args: tuple[str, ...], window: str, lateness: str) -> DataFrame:
    """Counts in tumbling windows; rows later than lateness are left out and closed windows are emitted once (append)."""
    grouped = stream.withWatermark(ts, lateness).groupBy(F.window(ts, window), *args)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *args, "n")


def bayes_filter(stream: DataFrame, key: str, order: str, observed: str, states: list[str], prior: np.ndarray, transition: np.ndarray, likelihood: dict[str, np.ndarray]) -> DataFrame:
    """key, steps and belief after each micro-batch: predict by transition (from x to), update by the observation.

    The state of a key is its belief; observations within a batch are taken in order.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, belief = (state.get[0], np.array(state.get[1])) if state.exists else (0, prior.astype(float))
        for x in pd.concat(list(batches)).sort_values(order)[observed]:
            belief = belief if steps == 0 else belief @ transition
            belief = belief * likelihood.get(x, np.ones(len(belief)))
            belief = belief / belief.sum()
            steps += 1
        state.update((steps, belief.tolist()))
        yield pd.DataFrame({key: [k[0]], "steps": [steps], **{f"p_{s}": [b] for s, b in zip(states, belief, strict=True)}})

    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, steps long, " + ", ".join(f"p_{s} double" for s in states)
    return stream.select(key, order, observed).groupBy(key).applyInPandasWithState(step, out, "steps long, belief array<double>", "update", GroupStateTimeout.NoTimeout)


class OnlineLogistic:
    """Binary logistic regression by stochastic gradient steps over a stream: each micro-batch is one aggregate and one step
    of falling size. The weights, one for each feature, stay on the driver."""

    def __init__(self, features: list[str], label: str, rate: float = 0.5, l2: float = 0.0):
        self.features, self.label, self.rate, self.l2 = features, label, rate, l2
        self.weights, self.steps = np.zeros(len(features) + 1), 0

    def step(self, batch: DataFrame, batch_id: int = 0) -> None:
        x = [F.lit(1.0), *(F.col(f).cast("double") for f in self.features)]
        score = sum((float(w) * c for w, c in zip(self.weights[1:], x[1:], strict=True)), F.lit(float(self.weights[0])))
        miss = F.col(self.label) - 1 / (1 + F.exp(-score))
        row = batch.agg(F.count("*").alias("n"), *(F.sum(miss * c).alias(f"g{k}") for k, c in enumerate(x))).first()
        if row["n"]:
            self.steps += 1
            g = np.array([row[f"g{k}"] or 0.0 for k in range(len(x))]) / row["n"]
            self.weights = self.weights + self.rate / np.sqrt(self.steps) * (g - self.l2 * self.weights)

    def run(self, stream: DataFrame, checkpoint: str) -> np.ndarray:
        """The weights once all that the stream holds now is read."""
        stream.writeStream.foreachBatch(self.step).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
        return self.weights


def assumed_density_filter(stream: DataFrame, key: str, order: str, observed: list[str], states: dict[str, int], transitions: dict[str, np.ndarray], likelihoods: dict[str, np.ndarray]) -> DataFrame:
    """key, variable, steps and belief (array) after each micro-batch, for processes of several variables whose belief is
    projected to independent ones after each step. transitions[v]: from x to of one variable; likelihoods[o]: for observed
    column o, an array over all variables' states and the column's codes. Updates are exact before the projection."""
    names = list(states)
    sizes = [states[v] for v in names]

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, flat = state.get if state.exists else (0, [x for n in sizes for x in [1 / n] * n])
        beliefs = [np.array(b) for b in np.split(np.array(flat), np.cumsum(sizes)[:-1])]
        for row in pd.concat(list(batches)).sort_values(order)[observed].itertuples(index=False):
            if steps:
                beliefs = [b @ transitions[v] for v, b in zip(names, beliefs, strict=True)]
            joint = beliefs[0]
            for b in beliefs[1:]:
                joint = np.multiply.outer(joint, b)
            for o, code in zip(observed, row, strict=True):
                joint = joint * likelihoods[o][..., int(code)]
            joint = joint / joint.sum()
            beliefs = [joint.sum(axis=tuple(a for a in range(len(names)) if a != i)) for i in range(len(names))]
            steps += 1
        state.update((steps, np.concatenate(beliefs).tolist()))
        yield pd.DataFrame({key: [k[0]] * len(names), "variable": names, "steps": steps, "belief": [b.tolist() for b in beliefs]})

    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, variable string, steps long, belief array<double>"
    return stream.select(key, order, *observed).groupBy(key).applyInPandasWithState(step, out, "steps long, beliefs array<double>", "update", GroupStateTimeout.NoTimeout)
