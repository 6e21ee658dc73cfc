"""Continuous conversion of staged files as they arrive: the same expressions over a stream, good and rejected rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keelson.operators.load import converted, good, rejects
from keelson.plans.model import TablePlan


def load_stream(rows: DataFrame, table: TablePlan, target: str, reject_dir: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write each batch's good rows below target and its rejects below reject_dir, each in a folder named by the batch; a batch that is repeated replaces its own folders."""

    def one(batch: DataFrame, number: int) -> None:
        made = converted(batch, table)
        made.persist()
        good(made, table).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")
        rejects(made, table).write.mode("overwrite").json(f"{reject_dir.rstrip('/')}/{table.id}/batch={number}")
        made.unpersist()

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
