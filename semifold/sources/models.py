"""Model files as factor tables, and matrices as coordinate tables: small readers over Spark's text source."""

from __future__ import annotations

import math
import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semifold.operators.dataset import with_row_index
from semifold.operators.lineage import kept


def uai_factors(spark: SparkSession, path: str) -> DataFrame:
    """factor_id, args (variable numbers), arities, cell and value of a UAI model file, one row for each table cell.

    Cells are numbered as in the file, the last argument fastest. Model files are small: one file is one row.
    """
    tokens = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("k"))

    def cells(batches):
        import pandas as pd

        for pdf in batches:
            for k in pdf["k"]:
                k = list(k)
                n = int(k[1])
                arity, at = [int(x) for x in k[2 : 2 + n]], 2 + n
                scopes, count = [], int(k[at])
                at += 1
                for _ in range(count):
                    size = int(k[at])
                    scopes.append([int(x) for x in k[at + 1 : at + 1 + size]])
                    at += 1 + size
                for f, scope in enumerate(scopes):
                    size = int(k[at])
                    values = [float(x) for x in k[at + 1 : at + 1 + size]]
                    at += 1 + size
                    yield pd.DataFrame({"factor_id": f, "args": [scope] * size, "arities": [[arity[a] for a in scope]] * size, "cell": range(size), "value": values})

    return tokens.mapInPandas(cells, "factor_id int, args array<int>, arities array<int>, cell int, value double")


def uai_evidence(spark: SparkSession, path: str) -> DataFrame:
    """variable and state of a UAI evidence file: a count and that many pairs."""
    k = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    tokens = spark.read.text(path, wholetext=True).select(F.transform(k, lambda x: x.cast("int")).alias("k"))
    pairs = F.explode(F.sequence(F.lit(0), F.get("k", F.lit(0)) - 1)).alias("i")
    return tokens.where(F.get("k", F.lit(0)) > 0).select("k", pairs).select(F.get("k", 1 + 2 * F.col("i")).alias("variable"), F.get("k", 2 + 2 * F.col("i")).alias("state"))


def save_beliefs(beliefs: DataFrame, path: str) -> None:
    """Beliefs (variable, state, value) as UAI marginals: one line of number of variables, then arity and values of each."""
    per = beliefs.groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("state", "value"))).alias("b"))
    text = F.concat_ws(" ", F.size("b").cast("string"), F.transform("b", lambda x: x["value"].cast("string")))
    lines = per.select("variable", text.alias("t")).agg(F.array_sort(F.collect_list(F.struct("variable", "t"))).alias("x"))
    whole = F.concat_ws(" ", F.size("x").cast("string"), F.transform("x", lambda x: x["t"]))
    lines.select(F.concat(F.lit("MAR\n"), whole).alias("value")).coalesce(1).write.text(path)


def bif_factors(spark: SparkSession, path: str) -> DataFrame:
    """child, parents, state, parent_states and value of a BIF network: one row for each table cell. Model files are small:
    one file is one row."""
    variable = re.compile(r"variable\s+(\S+)\s*\{[^}]*?\[\s*\d+\s*\]\s*\{([^}]*)\}")
    block = re.compile(r"probability\s*\(([^)]*)\)\s*\{([^}]*)\}")
    entry = re.compile(r"(?:table|\(([^)]*)\))\s*([^;]*);")
    comma = lambda t: [x.strip() for x in t.split(",") if x.strip()]

    def cells(batches):
        import pandas as pd

        for pdf in batches:
            for text in pdf["value"]:
                states = {m[1]: comma(m[2]) for m in variable.finditer(text)}
                rows = []
                for m in block.finditer(text):
                    child, _, given = m[1].partition("|")
                    child, parents = child.strip(), comma(given)
                    for e in entry.finditer(m[2]):
                        at = comma(e[1] or "")
                        values = [float(x) for x in comma(e[2])]
                        combos = [at] if at or not parents else [list(c) for c in product(*(states[q] for q in parents))]
                        for k, v in enumerate(values):  # a whole table lists the child's states fastest
                            n = len(states[child])
                            rows.append((child, parents, states[child][k % n], combos[k // n], v))
                yield pd.DataFrame(rows, columns=["child", "parents", "state", "parent_states", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(cells, "child string, parents array<string>, state string, parent_states array<string>, value double")


def pairwise_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Variables (id, arity) and potentials (factor_id, args, cell, value) of a text network with @Variables and @Potentials
    sections that end in @End; a potential is its number of arguments, their ids, and its values."""
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    whole = spark.read.text(path, wholetext=True).select(words.alias("k"))

    def section(k: list[str], name: str) -> list[str]:
        if name not in k:
            return []
        a = k.index(name) + 1
        return k[a : k.index("@End", a)]

    def variables(batches):
        import pandas as pd

        for pdf in batches:
            for k in pdf["k"]:
                own = section(list(k), "@Variables")
                own = own[len(own) % 2 :]  # a leading count is passed over
                yield pd.DataFrame({"id": [int(x) for x in own[::2]], "arity": [int(x) for x in own[1::2]]})

    def potentials(batches):
        import pandas as pd

        for pdf in batches:
            for k in pdf["k"]:
                k = list(k)
                own = section(k, "@Variables")
                own = own[len(own) % 2 :]
                arity = dict(zip(map(int, own[::2]), map(int, own[1::2]), strict=True))
                p, at, f = section(k, "@Potentials"), 0, 0
                while at < len(p):
                    n = int(p[at])
                    args = [int(x) for x in p[at + 1 : at + 1 + n]]
                    size = math.prod(arity[a] for a in args)
                    values = [float(x) for x in p[at + 1 + n : at + 1 + n + size]]
                    yield pd.DataFrame({"factor_id": f, "args": [args] * size, "cell": range(size), "value": values})
                    at, f = at + 1 + n + size, f + 1

    return whole.mapInPandas(variables, "id int, arity int"), whole.mapInPandas(potentials, "factor_id int, args array<int>, cell int, value double")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """i, j (from 0) and v of a MatrixMarket file of real, integer or pattern entries, coordinate or array; symmetric files
    give both triangles, skew-symmetric ones the other with the sign turned.

    The size line is the first that is no comment. It is known by its place: rows of the file's first block are numbered
    as they are read, and of one file the first block has the least numbers."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    head = spark.read.text(path).where(F.col("value").startswith("%%MatrixMarket")).select(F.lower("value")).first()
    words = (head[0] if head else "%%matrixmarket matrix coordinate real general").split()
    if words[3] == "complex" or words[4] == "hermitian":
        raise ValueError("complex matrices are not read")
    rows = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = rows.where(F.col("_block") == 0).agg(F.min(F.struct("_n", "value")).alias("s")).select("s.*").first()
    if first is None:
        return spark.createDataFrame([], "i long, j long, v double")
    p = F.split(F.trim("value"), r"\s+")
    entries = rows.where(~((F.col("_block") == 0) & (F.col("_n") == first["_n"]))).withColumn("p", p)
    if words[2] == "array":
        height, width = (int(x) for x in first["value"].split()[:2])
        below = {"symmetric": 0, "skew-symmetric": 1}.get(words[4])  # such files list each column from the diagonal, or below
        cells = entries.select(F.get("p", F.lit(0)).cast("double").alias("v"), "_block", "_n")
        at = with_row_index(cells, "_block", "_n", name="k").select("k", "v")
        if below is None:
            coo = at.select((F.col("k") % height).alias("i"), F.floor(F.col("k") / height).alias("j"), "v")
        else:
            starts = spark.createDataFrame([(j, j * height - j * (j - 1) // 2 - below * j, height - j - below) for j in range(width)], "j long, at long, n long")
            coo = at.join(starts, (F.col("k") >= F.col("at")) & (F.col("k") < F.col("at") + F.col("n"))).select((F.col("k") - F.col("at") + F.col("j") + below).alias("i"), "j", "v")
    else:
        v = F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0))
        coo = entries.select((F.get("p", F.lit(0)).cast("long") - 1).alias("i"), (F.get("p", F.lit(1)).cast("long") - 1).alias("j"), v.alias("v"))
    if words[4] in ("symmetric", "skew-symmetric"):
        sign = 1 if words[4] == "symmetric" else -1
        coo = coo.unionByName(coo.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("v")).alias("v")))
    return coo


def save_matrix_market(coo: DataFrame, path: str, rows: int, columns: int) -> None:
    """A general coordinate file, in one part: header, size line and entries by row."""
    n = coo.count()
    head = coo.sparkSession.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 0, 1, f"{rows} {columns} {n}")], "i long, j long, k int, value string")
    body = coo.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.lit(2).alias("k"), F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("i", "j", "k").select("value").write.text(path)


def dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j and v of a text matrix, one row for each line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    return lines.select("i", F.posexplode(F.split(F.trim("line"), r"[\s,]+")).alias("j", "v")).select("i", "j", F.col("v").cast("double"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of coordinate tables."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def power_iteration(coo: DataFrame, start: DataFrame, rounds: int, tolerance: float = 1e-10) -> tuple[float, DataFrame]:
    """Largest eigenvalue, in size, of a square matrix and its vector (i, v), from a start vector: a round is one join and
    one group-by."""
    v, value = kept(start), 0.0
    for _ in range(rounds):
        w = kept(multiply(coo, v.select("i", F.lit(0).cast("long").alias("j"), "v")).select("i", "v"))
        top = w.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
        dot = w.join(v.withColumnRenamed("v", "_o"), "i").agg(F.sum(F.col("v") * F.col("_o"))).first()[0] or 0.0
        v = w.withColumn("v", F.col("v") / top) if top else w
        if abs(dot - value) <= tolerance * max(abs(dot), 1.0) or not top:
            return dot, v
        value = dot
    return value, v
