"""Synthetic migration workloads of any size, each with its plan; every value follows from the row's number and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.plans.model import ColumnPlan, Kind, TablePlan

SEED = 20261002


def _plan(name: str, *columns: tuple) -> TablePlan:
    made = [ColumnPlan(n, n, source, target, kind, nullable=nullable) for n, source, target, kind, nullable in columns]
    return TablePlan(f"t_{name}", name, "bench", name, made, [made[0].source_name])


def narrow_integers(spark: SparkSession, rows: int) -> tuple[DataFrame, TablePlan]:
    """Four integer columns."""
    i = F.col("id")
    data = spark.range(1, rows + 1).select("id", (i % 1024).cast("int").alias("bucket"), ((i * 48271 + SEED) % 2147483647).alias("measure"), ((i * 69621 + SEED * 17) % 2147483629).alias("payload"))
    big = lambda n: (n, "bigint", "bigint", Kind.SIGNED, False)
    return data, _plan("narrow", big("id"), ("bucket", "int", "integer", Kind.SIGNED, False), big("measure"), big("payload"))


def skewed_keys(spark: SparkSession, rows: int) -> tuple[DataFrame, TablePlan]:
    """Sparse unsigned keys; nine rows of ten share a bucket."""
    i = F.col("id")
    bucket = F.when(i % 10 != 0, F.lit(0)).otherwise(i % 1024).cast("int")
    data = spark.range(1, rows + 1).select((i * 100_000).cast("decimal(20,0)").alias("id"), bucket.alias("bucket"))
    return data, _plan("skewed", ("id", "bigint unsigned", "numeric(20,0)", Kind.UNSIGNED, False), ("bucket", "int", "integer", Kind.SIGNED, False))


def wide_text(spark: SparkSession, rows: int) -> tuple[DataFrame, TablePlan]:
    """Text beyond ASCII, JSON and wide decimals."""
    i = F.col("id").cast("string")
    data = spark.range(1, rows + 1).select(
        "id", F.concat(F.lit("étiquette "), i).alias("label"), F.repeat(F.concat(F.lit("détail 🙂 "), i), 20).alias("detail"),
        F.concat(F.lit('{"n": '), i, F.lit(', "t": ["é"]}')).alias("json_doc"), F.concat(i, F.lit(".000000000001")).alias("amount"),
    )
    return data, _plan("wide", ("id", "bigint", "bigint", Kind.SIGNED, False), ("label", "varchar(24)", "varchar(24)", Kind.TEXT, True), ("detail", "text", "text", Kind.TEXT, True), ("json_doc", "json", "jsonb", Kind.JSON, True), ("amount", "decimal(30,12)", "numeric(30,12)", Kind.DECIMAL, True))


def bad_rows(spark: SparkSession, rows: int, every: int = 100) -> tuple[DataFrame, TablePlan]:
    """A NUL, which no text may hold, in every so many rows."""
    i = F.col("id")
    text = F.concat(F.lit("row"), F.when(i % every == 0, F.lit("\0")).otherwise(F.lit(" ")), i.cast("string"))
    return spark.range(1, rows + 1).select("id", text.alias("payload")), _plan("bad", ("id", "bigint", "bigint", Kind.SIGNED, False), ("payload", "text", "text", Kind.TEXT, True))
