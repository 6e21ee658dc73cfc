"""Reachability over dependency edges."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that every executor reaches: the one set or named by spark.checkpoint.dir, else a temporary one in local mode, where all is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|\Z)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    return sc.getCheckpointDir()


def closure(roots: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Nodes reachable from roots (node) over edges (parent, child[, kind]), roots included.

    Each round joins only the nodes that the last one found; cycles end it, as known nodes are
    dropped. A round writes its new nodes once, to the shared checkpoint folder; what is known is the union of these.
    """
    shared_folder(roots.sparkSession)
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(kinds))
    steps = edges.select(F.col("parent").alias("node"), "child").where("node IS NOT NULL AND child IS NOT NULL").distinct().checkpoint()
    seen = new = roots.select("node").where("node IS NOT NULL").distinct().checkpoint()
    while not new.isEmpty():
        found = new.join(steps, "node").select(F.col("child").alias("node")).distinct()
        new = found.join(seen, "node", "left_anti").checkpoint()
        seen = seen.unionAll(new)
    return seen
