"""Datasets: weighted rows of categorical, real and sequence columns. Projection, addressing, recoding and windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semifold.operators.lineage import kept


def with_row_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """df with consecutive numbers from 0 in the given order, without a global window: rows are range-sorted, numbered
    as they pass within their partition, stored, and shifted by the counts of the partitions before (one number each)."""
    fields = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            places = pa.array(range(before, before + b.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, places], [*b.schema.names, "_local"])
            before += b.num_rows

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = kept(placed.mapInArrow(numbered, f"{fields}, _part int, _local long"))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(base.select("_part", "_base"), "_part").withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_part", "_local", "_base")


def row_at(df: DataFrame, u: float, *order: str) -> DataFrame:
    """The row at share u in [0, 1) of the rows in order: a uniform row for a uniform u."""
    indexed = kept(with_row_index(df, *order))
    n = indexed.agg(F.count("*").alias("_n"))
    return indexed.join(n, F.col("row_idx") == F.floor(F.col("_n") * u)).drop("_n", "row_idx")


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from the key and the seed: the same on every run and cluster."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with position: the place of each row in a seeded permutation, by the keys' digests."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return with_row_index(df.withColumn("_digest", digest), "_digest", key, name="position").drop("_digest")


def inserted(df: DataFrame, records: DataFrame) -> DataFrame:
    """df and more records; columns that they lack are missing."""
    return df.unionByName(records, allowMissingColumns=True)


def updated(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """df with the given columns overwritten where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def restricted(df: DataFrame, assignment: dict[str, object]) -> DataFrame:
    """The rows that agree with assignment: an equality filter that reaches the scan."""
    return reduce(lambda x, kv: x.where(F.col(kv[0]) == F.lit(kv[1])), assignment.items(), df)


def weighted(df: DataFrame, weight: Column | float) -> DataFrame:
    """df with weight: a column's value or one number for all rows."""
    return df.withColumn("weight", (weight if isinstance(weight, Column) else F.lit(weight)).cast("double"))


def value_matrix(df: DataFrame, columns: list[str], ones: bool = False) -> DataFrame:
    """df with x, the row of the design matrix: the columns as one array, after a 1 if wanted."""
    return df.withColumn("x", F.array(*([F.lit(1.0)] if ones else []), *(F.col(c).cast("double") for c in columns)))


def assignments(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records as assignments: (key, variable, value), one row for each column that is not missing."""
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(key, pairs).where(F.col("value").isNotNull())


def records(assigned: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Assignments back to records: one row for each key, columns by name and type."""
    wide = assigned.groupBy(key).agg(*(F.max(F.when(F.col("variable") == c, F.col("value"))).cast(kind).alias(c) for c, kind in columns.items()))
    return wide


def held_out(df: DataFrame, fold: int, test: bool, column: str = "fold") -> DataFrame:
    """Of a dataset with folds, the fold itself or the rest."""
    return df.where(F.col(column) == fold if test else F.col(column) != fold)


def scored_filter(df: DataFrame, score: Column, least: float, keep_above: bool = True) -> DataFrame:
    """Rows whose raw score is above (or not above) a threshold."""
    return df.where(score > least if keep_above else score <= least)


def row_slices(df: DataFrame, slices: list[tuple[int, int]], index: str = "row_idx") -> DataFrame:
    """Union of half-open row ranges; rows of overlapping ranges repeat."""
    return reduce(DataFrame.unionAll, [df.where((F.col(index) >= a) & (F.col(index) < b)) for a, b in slices])


def rows_at(df: DataFrame, positions: DataFrame, index: str = "row_idx") -> DataFrame:
    """Rows by a table of (pos, row_idx): repeats allowed, order kept in pos."""
    return positions.join(df, index)


def kfold(df: DataFrame, k: int, n: int, index: str = "row_idx") -> DataFrame:
    """df with fold: contiguous folds of rows floor(i n / k) to floor((i + 1) n / k)."""
    i = F.floor(((F.col(index) + 1) * k - 1) / n)
    return df.withColumn("fold", i.cast("int"))


def recode(value: Column, coloring: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, coloring)), value)


def indicator(value: Column, of: object) -> Column:
    return (value == F.lit(of)).cast("int")


def merged_code(columns: list[Column], arities: list[int]) -> Column:
    """Mixed-radix code, the right-most column most significant."""
    code, radix = F.lit(0).cast("long"), 1
    for c, k in zip(columns, arities, strict=True):
        code, radix = code + c * radix, radix * k
    return code


def split_code(code: Column, arities: list[int]) -> list[Column]:
    out, radix = [], 1
    for k in arities:
        out.append(F.pmod(F.floor(code / radix), F.lit(k)).cast("int"))
        radix *= k
    return out


def count_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def z_scores(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Columns less their weighted mean, over their weighted population deviation: two passes, no window."""
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for c in columns:
        mean = F.sum(w * F.col(c)) / F.sum(w)
        aggs += [mean.alias(f"_m_{c}"), F.sqrt(F.greatest(F.sum(w * F.col(c) * F.col(c)) / F.sum(w) - mean * mean, F.lit(0.0))).alias(f"_s_{c}")]
    joined = df.crossJoin(df.agg(*aggs))
    scaled = joined.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns})
    return scaled.select(*df.columns)


def unit_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns]))
    return df.withColumns({c: F.when(norm > 0, F.col(c) / norm).otherwise(F.col(c)) for c in columns})


def sliding(df: DataFrame, seq: str, t: str, columns: list[str], history: int = 1) -> DataFrame:
    """One row for each step with `history` later steps in its sequence: columns c__0 .. c__history."""
    w = Window.partitionBy(seq).orderBy(t)
    ahead = {f"{c}__{k}": F.lead(c, k).over(w) if k else F.col(c) for c in columns for k in range(history + 1)}
    full = df.withColumns(ahead).withColumn("_more", F.lead(F.lit(1), history).over(w) if history else F.lit(1))
    return full.where(F.col("_more").isNotNull()).select(seq, t, *ahead)


def fixed_steps(df: DataFrame, seq: str, t: str, columns: list[str], first: int, last: int) -> DataFrame:
    """One row for each sequence with steps first .. last - 1 (steps numbered from 0 in order of t)."""
    w = Window.partitionBy(seq).orderBy(t)
    steps = df.withColumn("_step", F.row_number().over(w) - 1).where(F.col("_step").between(first, last - 1))
    wide = steps.groupBy(seq).agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("_step") == k, F.col(c))).alias(f"{c}__{k - first}") for c in columns for k in range(first, last)))
    return wide.where(F.col("_n") == last - first).drop("_n")


def cycled(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """A finite dataset as an endless source cut at limit: position from 0, rows in order, again from the first when all have
    passed."""
    indexed = kept(with_row_index(df, *order))
    n = indexed.agg(F.count("*").alias("_n"))
    places = df.sparkSession.range(limit).crossJoin(n).where(F.col("_n") > 0).select(F.col("id").alias("position"), (F.col("id") % F.col("_n")).alias("row_idx"))
    return places.join(indexed, "row_idx").drop("row_idx")


def taken(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a source as a dataset."""
    return df.orderBy(*order).limit(n)


def permuted(df: DataFrame, permutation: DataFrame, index: str = "row_idx") -> DataFrame:
    """Rows at new places by a permutation table (row_idx, place)."""
    return df.join(permutation, index).drop(index).withColumnRenamed("place", index)


def printed(df: DataFrame, columns: list[str], mode: str = "default", missing: str = "?") -> DataFrame:
    """line: records as text. default: values between spaces; tabbed: between tabs; vars: name=value; tabbed_weighted: the
    weight last."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    cells = [F.concat(F.lit(f"{c}="), show(c)) if mode == "vars" else show(c) for c in columns]
    if mode == "tabbed_weighted":
        cells.append(show("weight"))
    return df.withColumn("line", F.concat_ws("\t" if mode.startswith("tabbed") else " ", *cells))


def find_first(df: DataFrame, seq: str, t: str, condition: Column) -> DataFrame:
    """For each sequence the first t where the condition holds, and how often it does: combined before the shuffle."""
    return df.groupBy(seq).agg(F.min(F.when(condition, F.col(t))).alias("first"), F.sum(condition.cast("long")).alias("n"))


def search_sequence(df: DataFrame, seq: str, t: str, column: str, pattern: list) -> DataFrame:
    """Places (seq, t) where the values of pattern stand one after another."""
    wide = sliding(df, seq, t, [column], len(pattern) - 1)
    return reduce(lambda x, kv: x.where(F.col(f"{column}__{kv[0]}") == F.lit(kv[1])), enumerate(pattern), wide).select(seq, t)


# Views of sequences: tables of steps (a sequence's key, t from 0).


def numbered_steps(df: DataFrame, sequence: str, *order: str) -> DataFrame:
    """df with t, the place of each row in its sequence. A window over one sequence: its rows stream through a sorted task."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(sequence).orderBy(*order)) - 1).cast("long"))


def sequence_slice(df: DataFrame, t: str, begin: int, end: int) -> DataFrame:
    """The steps from begin up to end (not included), numbered from 0; sequences without such steps are left out."""
    return df.where((F.col(t) >= begin) & (F.col(t) < end)).withColumn(t, F.col(t) - begin)


def shuffled_sequences(df: DataFrame, sequence: str, seed: int = 0) -> DataFrame:
    """df with place: whole sequences in a seeded permutation. Only the keys are put in order, not the steps."""
    keys = shuffled(df.select(sequence).distinct(), sequence, seed)
    return df.join(keys.select(sequence, F.col("position").alias("place")), sequence)


def inserted_sequences(df: DataFrame, more: DataFrame, sequence: str) -> DataFrame:
    """The sequences of both; an error where a sequence of more is there already."""
    there = df.select(sequence).distinct().withColumn("_there", F.lit(True))
    checked = more.join(there, sequence, "left").withColumn(sequence, F.when(F.col("_there").isNull(), F.col(sequence)).otherwise(F.raise_error(F.lit("a sequence is there already"))))
    return df.unionByName(checked.select(*df.columns))
