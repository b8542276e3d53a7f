"""Synthetic sources: rows are made by range and digest, so the same key and seed give the same row on every cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semifold.operators.dataset import uniform


def normal(*key: Column | str, seed: int = 0) -> Column:
    """A standard normal number by the Box-Muller rule from two uniform ones; the first is kept above 0."""
    a, b = uniform(*key, F.lit("radius"), seed=seed), uniform(*key, F.lit("angle"), seed=seed)
    return F.sqrt(-2 * F.ln(F.greatest(a, F.lit(2.0**-33)))) * F.cos(2 * math.pi * b)


def majority_vote(spark: SparkSession, n: int, bits: int, noise: float, seed: int = 0) -> DataFrame:
    """id, x0 .. and y: fair bits and their majority (1 if half or more), turned over with the given odds."""
    df = spark.range(n)
    x = {f"x{k}": (uniform("id", F.lit(f"x{k}"), seed=seed) < 0.5).cast("int") for k in range(bits)}
    df = df.withColumns(x)
    vote = (2 * sum((F.col(c) for c in x), F.lit(0)) >= bits).cast("int")
    turned = uniform("id", F.lit("noise"), seed=seed) < noise
    return df.withColumn("y", F.when(turned, 1 - vote).otherwise(vote))


def gaussian_clusters(spark: SparkSession, n: int, k: int, dims: int, spread: float, seed: int = 0) -> DataFrame:
    """id, cluster and x0 ..: k Gaussians with centres drawn in the unit cube, each row's cluster drawn evenly."""
    df = spark.range(n).withColumn("cluster", F.floor(uniform("id", F.lit("cluster"), seed=seed) * k).cast("int"))
    return df.withColumns({f"x{j}": uniform("cluster", F.lit(f"centre{j}"), seed=seed) + spread * normal("id", F.lit(f"x{j}"), seed=seed) for j in range(dims)})


def noisy_image(spark: SparkSession, height: int, width: int, noise: float, seed: int = 0) -> DataFrame:
    """id (row by row), truth (a disc of half the height) and seen, the truth turned over with the given odds."""
    row, col = F.floor(F.col("id") / width), F.col("id") % width
    inside = (row - (height - 1) / 2) ** 2 + (col - (width - 1) / 2) ** 2 <= (height / 4) ** 2
    df = spark.range(height * width).withColumn("truth", inside.cast("int"))
    return df.withColumn("seen", F.when(uniform("id", seed=seed) < noise, 1 - F.col("truth")).otherwise(F.col("truth")))


def ising_factors(edges: DataFrame, strength: float, seed: int = 0, kind: str = "mixed") -> DataFrame:
    """(u, v, su, sv, value) for edges (src, dst): exp(c) where the states agree, exp(-c) where not; c is drawn from
    [-strength, strength], or from [0, strength] for attractive (associative) models."""
    u = uniform("src", "dst", seed=seed)
    c = strength * u if kind == "attractive" else strength * (2 * u - 1)
    state = lambda name: F.explode(F.array(F.lit(0), F.lit(1))).alias(name)
    rows = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), c.alias("_c"), state("su")).select("u", "v", "_c", "su", state("sv"))
    return rows.select("u", "v", "su", "sv", F.exp(F.when(F.col("su") == F.col("sv"), F.col("_c")).otherwise(-F.col("_c"))).alias("value"))


def denoising_model(image: DataFrame, edges: DataFrame, trust: float, smooth: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (v, s, value) and edges of a grid model for an image: exp(trust) for the seen state, exp(smooth) for neighbours
    in one state."""
    state = F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    nodes = image.select(F.col("id").alias("v"), "seen", state).select("v", "s", F.when(F.col("s") == F.col("seen"), F.exp(F.lit(trust))).otherwise(1.0).alias("value"))
    two = lambda name: F.explode(F.array(F.lit(0), F.lit(1))).alias(name)
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), two("su")).select("u", "v", "su", two("sv"))
    return nodes, e.withColumn("value", F.when(F.col("su") == F.col("sv"), F.exp(F.lit(smooth))).otherwise(1.0))
