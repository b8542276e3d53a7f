"""Queries of sources, sinks and streams: tables written to the session's folder and read back, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from semifold.operators.lineage import fresh
from semifold.plans.registry import query, r, t
from semifold.sources import models, symbolic, synthetic
from semifold.streaming import estimation


def number(text: str) -> str:
    """In SQL: a number in [0, 1) from a digest, as dataset.uniform draws it."""
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0"


FORM = symbolic.SymbolicFormat([("brand", [f"Brand#{k}" for k in range(100)]), ("size", 51), ("price", "vector(1)")], separator="\t", skip_rows=2, skip_cols=1, weighted=True)


@query("SELECT p_brand, CAST(nullif(p_size, 7) AS INT) AS size, p_retailprice AS price, CAST(p_size AS DOUBLE) AS weight FROM part")
def symbolic_round_trip(spark, d):
    """Labels, codes and reals with missing values, skipped lines and columns, and weights, through text files."""
    labels = F.array(*map(F.lit, FORM.variables[0][1]))
    p = t(spark, d, "part").select((F.array_position(labels, F.col("p_brand")) - 1).cast("int").alias("brand"), F.expr("nullif(p_size, 7)").cast("int").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("weight"))
    path = fresh(spark, "text")
    symbolic.save(p, path, FORM)
    again = symbolic.load(spark, path, symbolic.SymbolicFormat.load_config(FORM.save_config()))
    return again.select(F.get(labels, F.col("brand")).alias("p_brand"), "size", "price", "weight")


@query("SELECT s_suppkey, s_name FROM supplier")
def archive_round_trip(spark, d):
    path = fresh(spark, "archive")
    symbolic.save_archive(t(spark, d, "supplier").select("s_suppkey", "s_name"), path, {"s_suppkey": "long"})
    df, metadata = symbolic.load_archive(spark, path)
    return df.select(*metadata, "s_name")


COO = "WITH c AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) "


def coo(spark, d):
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    return t(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("i"), code.alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"{COO} SELECT i, j, round(v, 4) AS v FROM c")
def matrix_market_round_trip(spark, d):
    path = fresh(spark, "matrix")
    models.save_matrix_market(coo(spark, d), path, 7, 3)
    return r(models.matrix_market(spark, path), "v", places=4)


@query(f"{COO} SELECT a.i, b.i AS j, round(sum(a.v * b.v) / 1000, 2) AS v FROM c a JOIN c b USING (j) GROUP BY 1, 2")
def sparse_product(spark, d):
    m = coo(spark, d)
    return models.multiply(m, models.transpose(m)).withColumn("v", F.round(F.col("v") / 1000, 2))


@query("SELECT 0.0 AS residual")
def power_iteration(spark, d):
    """How far A v is from the eigenvalue times v, for the product of a matrix with its transpose."""
    m = coo(spark, d)
    a = models.multiply(models.transpose(m), m).withColumn("v", F.col("v") / 1e6)
    value, v = models.power_iteration(a, spark.range(3).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), 60)
    w = models.multiply(a, v.select("i", F.lit(0).cast("long").alias("j"), "v")).select("i", F.col("v").alias("w"))
    far = w.join(v, "i").agg(F.sqrt(F.sum((F.col("w") - value * F.col("v")) ** 2)).alias("residual"))
    return far.select(F.round(F.col("residual") / abs(value), 4).alias("residual"))


BITS = ", ".join(f"CAST({number(f'''concat('5|', id, '|x{k}')''')} < 0.5 AS INT) AS x{k}" for k in range(5))


@query(f"WITH b AS (SELECT id, {BITS}, {number('''concat('5|', id, '|noise')''')} < 0.1 AS turned FROM range(2000) r(id)) SELECT id, x0, x1, x2, x3, x4, CASE WHEN turned THEN 1 - CAST(x0 + x1 + x2 + x3 + x4 >= 3 AS INT) ELSE CAST(x0 + x1 + x2 + x3 + x4 >= 3 AS INT) END AS y FROM b")
def majority_vote_source(spark, d):
    return synthetic.majority_vote(spark, 2000, 5, 0.1, seed=5)


_RADIUS, _ANGLE = number("concat('3|', id, '|x0|radius')"), number("concat('3|', id, '|x0|angle')")


@query(f"WITH c AS (SELECT id, CAST(floor({number('''concat('3|', id, '|cluster')''')} * 4) AS INT) AS cluster, {_RADIUS} AS a, {_ANGLE} AS b FROM range(1000) r(id)) SELECT id, cluster, round({number('''concat('3|', cluster, '|centre0')''')} + 0.05 * sqrt(-2 * ln(greatest(a, power(2, -33)))) * cos(2 * pi() * b), 6) AS x0 FROM c")
def gaussian_cluster_source(spark, d):
    return r(synthetic.gaussian_clusters(spark, 1000, 4, 2, 0.05, seed=3).select("id", "cluster", "x0"), "x0")


@query(f"WITH g AS (SELECT id, CAST(power(floor(id / 24.0) - 9.5, 2) + power(id % 24 - 11.5, 2) <= 25 AS INT) AS truth FROM range(480) r(id)) SELECT id, truth, CASE WHEN {number('''concat('2|', id)''')} < 0.2 THEN 1 - truth ELSE truth END AS seen FROM g")
def noisy_image_source(spark, d):
    return synthetic.noisy_image(spark, 20, 24, 0.2, seed=2)


@query(f"WITH v AS (SELECT x AS u, x + 1 AS v FROM range(48) t(x) WHERE x % 8 < 7 UNION ALL SELECT x, x + 8 FROM range(40) t(x)), c AS (SELECT u, v, 1.5 * (2 * ({number('''concat('4|', u, '|', v)''')}) - 1) AS c FROM v) SELECT u, v, CAST(a AS INT) AS su, CAST(b AS INT) AS sv, round(exp(CASE WHEN a = b THEN c ELSE -c END), 6) AS value FROM c, range(2) x(a), range(2) y(b)")
def ising_factor_source(spark, d):
    from semifold.operators.graph import grid_graph

    return r(synthetic.ising_factors(grid_graph(spark, 6, 8), 1.5, seed=4), "value")


# Streams over the events table, run until all of it is read.


def events(spark, d):
    form = t(spark, d, "events").schema
    return spark.readStream.schema(form).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(form).parquet(f"{d}/events.parquet")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def finished(df, spark, mode: str):
    """The stream's result once all its input is read: a table in the session's folder, which micro-batches append to, or
    write anew in the mode complete."""
    path, schema = fresh(spark, "stream"), df.schema
    spark.createDataFrame([], schema).write.parquet(path)
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    df.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", fresh(spark, "progress")).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("SELECT event_type, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def stream_incremental_counts(spark, d):
    return finished(estimation.incremental_counts(events(spark, d), ("event_type",)), spark, "complete")


@query("WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, max(ts) OVER () AS last FROM events) SELECT start, event_type, count(*) AS n FROM e WHERE start + INTERVAL 6 HOUR <= last - INTERVAL 1 HOUR GROUP BY start, event_type")
def stream_windowed_counts(spark, d):
    """Windows that the watermark, an hour behind the last event, has closed."""
    stream = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return finished(estimation.windowed_counts(stream, "ts", ("event_type",), "6 hours", "1 hour"), spark, "append").withColumn("start", F.col("start").cast("timestamp_ntz"))
