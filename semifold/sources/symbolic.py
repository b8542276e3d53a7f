"""Symbolic text datasets: delimited lines of categorical labels, codes and reals under a declared format."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semifold.functions.scalar import split_any


@dataclass
class SymbolicFormat:
    """Columns as (name, kind): kind is a list of labels, an arity (int) or "vector(d)". Missing cells become null.

    Runs of separator characters separate once. The first skip_rows lines and skip_cols columns are passed over; a
    weighted dataset ends each line with the weight.
    """

    variables: list[tuple[str, list[str] | int | str]]
    separator: str = " \t"
    missing: str = "?"
    skip_rows: int = 0
    skip_cols: int = 0
    weighted: bool = False
    process: bool = field(default=False)

    @classmethod
    def load_config(cls, text: str) -> SymbolicFormat:
        """From the text of an INI file with [variables] and [options]."""
        ini = configparser.ConfigParser(interpolation=None, delimiters=("=",))
        ini.optionxform = str
        ini.read_string(text)
        section = "variables" if ini.has_section("variables") else "discrete_processes"
        variables: list[tuple[str, list[str] | int | str]] = []
        for name, kind in ini[section].items():
            kind = kind.strip()
            if kind.startswith("finite("):
                variables.append((name, int(kind[7:-1])))
            elif kind.startswith("vector("):
                variables.append((name, kind))
            else:
                variables.append((name, [x.strip() for x in kind.strip("{}").split(",")]))
        o = ini["options"] if ini.has_section("options") else {}
        sep = {"tab": "\t", "space": " ", "comma": ","}.get(o.get("separator", ""), o.get("separator", " \t") or " \t")
        return cls(variables, sep, o.get("missing", "?"), int(o.get("skip_rows", 0)), int(o.get("skip_cols", 0)), str(o.get("weighted", "0")).lower() in ("1", "true", "yes"), section == "discrete_processes")

    def save_config(self) -> str:
        rows = [f"{n} = {'finite(%d)' % k if isinstance(k, int) else k if isinstance(k, str) else ', '.join(k)}" for n, k in self.variables]
        sep = {"\t": "tab", " ": "space", ",": "comma"}.get(self.separator, self.separator)
        head = "discrete_processes" if self.process else "variables"
        return "\n".join([f"[{head}]", *rows, "", "[options]", f"separator = {sep}", f"missing = {self.missing}", f"skip_rows = {self.skip_rows}", f"skip_cols = {self.skip_cols}", f"weighted = {int(self.weighted)}", ""])

    def width(self, kind) -> int:
        return int(kind[7:-1]) if isinstance(kind, str) else 1

    def columns(self, parts: Column) -> list[Column]:
        """Typed columns from the array of a line's cells; a wrong number of cells or an unknown label is an error."""
        need = self.skip_cols + sum(self.width(k) for _, k in self.variables) + self.weighted
        checked = F.when(F.size(parts) == need, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {need} cells, found "), F.size(parts).cast("string"))))
        out, at = [], self.skip_cols
        cell = lambda i: F.when(F.get(checked, F.lit(i)) != self.missing, F.get(checked, F.lit(i)))
        for name, kind in self.variables:
            if isinstance(kind, str):
                d = self.width(kind)
                values = [cell(at + j).cast("double") for j in range(d)]
                whole = values[0] if d == 1 else F.when(sum(v.isNull().cast("int") for v in values) == 0, F.array(*values))
                out.append(whole.alias(name))
                at += d
                continue
            raw = cell(at)
            if isinstance(kind, int):
                code = raw.cast("int")
                bad = (code < 0) | (code >= kind)
            else:
                code = F.array_position(F.array(*map(F.lit, kind)), raw).cast("int") - 1
                bad = code < 0
            out.append(F.when(raw.isNull(), F.lit(None).cast("int")).when(bad, F.raise_error(F.concat(F.lit(f"{name}: unknown value "), raw)).cast("int")).otherwise(code).alias(name))
            at += 1
        out.append((F.get(checked, F.lit(at)).cast("double") if self.weighted else F.lit(1.0)).alias("weight"))
        return out


def load(spark: SparkSession, path: str, form: SymbolicFormat) -> DataFrame:
    """The rows of text files under path: typed columns and weight. Skipped rows are the first of each file.

    Files are read by splits. Rows are numbered as they are read; within a file's first split, a row's number less the
    least one there is its line."""
    lines = spark.read.text(path)
    if form.skip_rows:
        lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
        first = lines.where(F.col("_block") == 0).groupBy("_file").agg(F.min("_n").alias("_first"))
        early = (F.col("_block") == 0) & (F.col("_n") - F.col("_first") < form.skip_rows)
        lines = lines.join(first, "_file", "left").where(~F.coalesce(early, F.lit(False)))
    lines = lines.where(F.trim("value") != "")
    return lines.select(*form.columns(split_any(F.col("value"), form.separator)))


def legacy_format(arities: list[int], prefix: str = "", index_base: int = 0, names: list[str] | None = None, **options) -> SymbolicFormat:
    """A format whose values are prefix and number, counted from index_base: labels in that order."""
    labels = [[f"{prefix}{k + index_base}" for k in range(n)] for n in arities]
    return SymbolicFormat(list(zip(names or [f"v{k}" for k in range(len(arities))], labels, strict=True)), **options)


def load_sequences(spark: SparkSession, path: str, form: SymbolicFormat) -> DataFrame:
    """One sequence for each file: seq_id (its path), t from 0, the columns, and weight 1."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("seq_id"), F.posexplode(F.split("value", r"\r?\n")).alias("_line", "value"))
    lines = lines.where((F.col("_line") >= form.skip_rows) & (F.trim("value") != "")).withColumn("t", (F.col("_line") - form.skip_rows).cast("int"))
    return lines.select("seq_id", "t", *form.columns(split_any(F.col("value"), form.separator)))


def save(df: DataFrame, path: str, form: SymbolicFormat) -> None:
    """Text files that load() reads back; skipped columns are written as 0, nulls as the missing sign, weight last."""
    sep = form.separator[0]
    cells: list[Column] = [F.lit("0")] * form.skip_cols
    for name, kind in form.variables:
        if isinstance(kind, str):
            d = form.width(kind)
            cells += [F.coalesce((F.col(name) if d == 1 else F.get(name, F.lit(j))).cast("string"), F.lit(form.missing)) for j in range(d)]
        else:
            shown = F.col(name).cast("string") if isinstance(kind, int) else F.get(F.array(*map(F.lit, kind)), F.col(name))
            cells.append(F.coalesce(shown, F.lit(form.missing)))
    if form.weighted:
        cells.append(F.col("weight").cast("string"))
    line = F.concat_ws(sep, *cells)
    if form.skip_rows:  # every part file begins with the lines that a reader passes over
        def headed(batches):
            first = True
            for pdf in batches:
                lines = pdf["value"].tolist()
                yield pdf.__class__({"value": [""] * form.skip_rows * first + lines})
                first = False

        df.select(line.alias("value")).mapInPandas(headed, "value string").write.text(path)
    else:
        df.select(line.alias("value")).write.text(path)


def save_archive(df: DataFrame, path: str, metadata: dict) -> None:
    """Parquet with a JSON sidecar of variable metadata, both through Spark's writers."""
    df.write.parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load_archive(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
