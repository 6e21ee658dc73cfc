"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.closure import shared_folder

ROOT = Path(__file__).resolve().parent.parent.parent


#: Bytes of rows that reach a Python worker at a time: with texts of any length a batch stays small.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers: bound their batches by bytes, not only by rows, and make
    this library importable where it isn't on their path already."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_keelson_shipped", False):
        return
    d = tempfile.mkdtemp(prefix="keelson-lib-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(d, "keelson"), "zip", ROOT, "keelson"))
    sc._keelson_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shielded(operator):
    """Guard an operator on (rows, ...) that carries other columns along and works with names that begin with two underscores.

    Such columns of the input keep their names and values in the result; one that is named as a
    result of the operator gives way to that.
    """

    @functools.wraps(operator)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        held = {c: f"held{i}:{c}" for i, c in enumerate(rows.columns) if c.startswith("__")}
        if not held:
            return operator(rows, *args, **kwargs)
        out = operator(rows.withColumnsRenamed(held), *args, **kwargs)
        own = {c.lower() for c in out.columns}
        back = {h: c for c, h in held.items() if c.lower() not in own}
        return out.drop(*(h for h in held.values() if h not in back)).withColumnsRenamed(back)

    return run


MOST_SENT = 200_000  # rows of a few numbers each that are broadcast


def few(keys: DataFrame) -> DataFrame:
    """A table of keys and a few numbers, written; marked for broadcast where it has MOST_SENT rows at most.

    Then the rows that it is joined to stay where they are, so those of a very common key aren't gathered. A larger table
    is joined by shuffles of both sides, whose skewed partitions Spark splits.
    """
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def extended(rows: DataFrame, more: str, drop: tuple[str, ...] = ()) -> T.StructType:
    """The schema of rows without some columns and with more, given as DDL, after them."""
    kept = [f for f in rows.schema if f.name not in drop]
    return T.StructType([*kept, *T._parse_datatype_string(more)])


def apart(key: Column) -> Column:
    """The same whole number as an expression that Spark doesn't match with the key's partitioning.

    A join on it shuffles this side for itself instead of building on an aggregation's shuffle;
    only joins between two shuffles of their own can have their skewed partitions split at run time.
    """
    return key.bitwiseXOR(F.lit(0).cast("long"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose texts hold about most_bytes together; a longer text is a run of its own."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share the keys, from batches in which these rows follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
