"""Reading and writing matrices as delimited triplets or parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import COO_SCHEMA, TAGGED_COO_SCHEMA, BlockMatrix
from ..operators.layout import coo_to_blocks
from .dims import matrix_dims
from .staging import stage


def _sound(bad: dict[str, Column]) -> Column:
    """True, or a task failure that names the column for which ``bad`` holds.

    Whatever is asked of the lines, a count or a few columns or rows, they are read and checked whole.
    """
    failures = [(F.coalesce(b, F.lit(True)), F.raise_error(F.lit(f"bad value in column {name}"))) for name, b in bad.items()]
    sound = F.lit(True)
    for b, failure in failures:
        sound = F.when(b, failure.cast("boolean")).otherwise(sound)
    return sound


def _read(
    spark: SparkSession, path: str, schema: T.StructType, partitions: int | None, fmt: str, names: tuple[str, ...] = ()
) -> DataFrame:
    if fmt == "csv":
        df = spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
    elif fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")
    bad = {"i": F.col("i") < 0, "j": F.col("j") < 0, "v": F.col("v").isNull()}
    if names:
        bad["mat"] = ~F.col("mat").isin(*names)
    # As a filter for counts, and around each column for filters that Spark would evaluate first.
    df = df.where(_sound(bad)).select(*[F.when(_sound(bad), F.col(f.name)).alias(f.name) for f in schema])
    # Round-robin, so that a cell or row holding much of the file is spread all the same.
    return df.repartition(partitions) if partitions else df


def read_coo(spark: SparkSession, path: str, partitions: int | None = None, fmt: str = "csv") -> DataFrame:
    """One matrix per file: lines ``row,col,value`` without header -> coo."""
    return _read(spark, path, COO_SCHEMA, partitions, fmt)


def read_tagged(
    spark: SparkSession,
    path: str,
    partitions: int | None = None,
    fmt: str = "csv",
    names: tuple[str, ...] = ("A", "B"),
) -> DataFrame:
    """Both operands in one file: lines ``name,row,col,value`` -> tagged coo; a name not in ``names`` fails the read."""
    return _read(spark, path, TAGGED_COO_SCHEMA, partitions, fmt, names)


@dataclass(frozen=True)
class Sorted:
    """``good`` entries, as :func:`read_coo` or :func:`read_tagged` gives them, and ``bad`` lines: ``file, line, reason``."""

    good: DataFrame
    bad: DataFrame


def read_quarantined(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> Sorted:
    """A triplet file whose bad lines are set aside instead of failing the read; tagged lines if ``names`` are given.

    Lines are parsed by the reader that :func:`read_coo` uses, so ``good`` is what that accepts line by line; every other
    line but empty ones, which it skips, is in ``bad`` once, with the first of the reasons ``not a triplet``, ``missing value``,
    ``negative index`` and ``unknown name``. Nothing is gathered anywhere: both frames are filters on the same scan.
    """
    schema = TAGGED_COO_SCHEMA if names else COO_SCHEMA
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*schema, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("file", F.col("value").alias("line"), F.from_csv("value", fields, options).alias("r"))
    missing = F.lit(False)
    for f in schema:
        missing = missing | F.col(f"r.{f.name}").isNull()
    reason = (
        F.when(F.col("r._bad").isNotNull(), "not a triplet")
        .when(missing, "missing value")
        .when((F.col("r.i") < 0) | (F.col("r.j") < 0), "negative index")
    )
    if names:
        reason = reason.when(~F.col("r.mat").isin(*names), "unknown name")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason IS NULL").select(*[f"r.{f.name}" for f in schema])
    return Sorted(good, parsed.where("reason IS NOT NULL").select("file", "line", "reason"))


def read_blocks(
    spark: SparkSession,
    path: str,
    bs: int,
    dims: tuple[int, int] | None = None,
    on_duplicate: str = "sum",
    partitions: int | None = None,
    fmt: str = "csv",
) -> BlockMatrix:
    """A triplet file as a block matrix.

    Without ``dims`` the parsed entries are staged, so that the text is read once, and one aggregate job finds them.
    """
    coo = read_coo(spark, path, partitions, fmt)
    if dims is None:
        coo = stage(coo, "entries")
        dims = matrix_dims(coo)
    return coo_to_blocks(coo, bs, dims, on_duplicate)


def write_coo(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write coo or tagged coo entries; CSV has no header, as the readers expect."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")
    df.write.format(fmt).mode(mode).save(path)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first entries in (i, j) order; bounded by ``rows``, which becomes a distributed top-k."""
    return df.orderBy("i", "j").limit(rows)
