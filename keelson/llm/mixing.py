"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's rows are cut into blocks. Its j-th block (from 1) is released at slot
floor((j-1)/w) and due by slot ceil(j/w) for a weight w; earliest deadline first over the
released blocks keeps every source within one block of its share at every slot. Weights
are whole numbers, so the schedule repeats after as many slots as they sum to: one period is computed
and the slot of any block follows by arithmetic. When a source runs out the others
go on with their weights among themselves, in a new phase. Every row gets a place; none is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import shielded, table

REST = "*"  # stands for all sources that the weights don't name, and for a null source


def period(weights: dict[str, int]) -> list[str]:
    """The sources of one period's slots, by earliest deadline among released blocks; ties to the larger weight, then by name."""
    total = sum(weights.values())
    soon: list[tuple[int, int, str, int]] = []  # released: deadline, minus weight, source, block
    later = [(0, s, 1) for s in sorted(weights) if weights[s] > 0]
    heapq.heapify(later)
    out = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            heapq.heappush(soon, (-(-j * total // weights[s]), -weights[s], s, j))
        _, _, s, j = heapq.heappop(soon)
        out.append(s)
        if j < weights[s]:
            heapq.heappush(later, (j * total // weights[s], s, j + 1))
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """Phases of the schedule until all blocks are placed: first slot, each source's first block, and one period's slots by source.

    As many phases as sources at most; a phase ends with the slot that takes the last block of a source.
    """
    done, slot, out = dict.fromkeys(blocks, 0), 0, []
    while active := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        g = math.gcd(*active.values())
        active = {s: w // g for s, w in active.items()}
        order = period(active)
        places: dict[str, list[int]] = {s: [] for s in active}
        for i, s in enumerate(order):
            places[s].append(i)

        def last(s: str) -> int:
            n = blocks[s] - done[s] - 1  # noqa: B023
            return n // active[s] * len(order) + places[s][n % active[s]]  # noqa: B023

        end = min(last(s) for s in active) + 1
        out.append({"slot": slot, "done": {s: done[s] for s in active}, "weights": active, "places": places, "length": len(order)})
        full, part = divmod(end, len(order))
        for s in active:
            done[s] += full * active[s] + sum(p < part for p in places[s])
        slot += end
    return out


@shielded
def mix(rows: DataFrame, weights: dict[str, int], block_rows: int = 64, bucket_rows: int = 500, least: int = 1) -> DataFrame:
    """rows (doc_id, source and any other columns) with __source, __block, __slot and __place.

    weights: whole target weights by source; REST is for all others and gets `least` if not
    named; so the sources to schedule are as many as the weights name, and one more. A source's
    order is that of a hash of the whole row, then doc_id; rows that repeat each other have a place each. __place runs from
    0 without gaps over all rows, by slot and order. An empty table gives an empty one.
    Names that begin with two underscores are as common.shielded says.
    """
    weights = {REST: least} | {k: int(w) for k, w in weights.items() if int(w) > 0}
    named = [w for w in weights if w != REST]
    source = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(REST))
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    mark = F.xxhash64(F.lit(23), *plain)
    marked = rows.withColumns({"__source": source, "__mark": F.shiftrightunsigned(mark, 1)})
    counts = dict(marked.groupBy("__source").count().collect())
    # a bucket is a range of the hash, so buckets in their order are the source's order; a large source has more
    parts = F.lit(1)
    for s, c in counts.items():
        parts = F.when(F.col("__source") == s, max(1, math.ceil(c / bucket_rows))).otherwise(parts)
    at = F.floor(F.col("__mark") / F.lit(2.0**63) * parts).cast("int")
    dealt = marked.withColumn("__bucket", F.least(at, parts - 1))
    sizes = _before(dealt.groupBy("__source", "__bucket").count())
    order = Window.partitionBy("__source", "__bucket").orderBy("__mark", "doc_id", F.monotonically_increasing_id())
    ranked = dealt.withColumn("__index", F.row_number().over(order) - 1).join(sizes, ["__source", "__bucket"])
    ranked = ranked.withColumn("__index", F.col("__index") + F.col("__before"))
    blocks = {s: -(-c // block_rows) for s, c in counts.items()}
    plan = phases({s: weights[s] for s in blocks}, blocks)
    block = F.floor(F.col("__index") / block_rows)
    ranked = ranked.withColumn("__block", block).join(F.broadcast(_courses(rows.sparkSession, plan)), "__source").withColumn("__slot", _slot())
    # places: whole blocks before a slot, less what short last blocks lack
    short = {s: c % block_rows for s, c in counts.items() if c % block_rows}
    gaps = [(_slot_of(plan, s, blocks[s] - 1), block_rows - r) for s, r in short.items()]
    lack = F.lit(0)
    for slot, missing in gaps:
        lack = lack + F.when(F.col("__slot") > slot, missing).otherwise(0)
    place = F.col("__slot") * block_rows + F.col("__index") % block_rows - lack
    return ranked.withColumn("__place", place.cast("long")).drop("__mark", "__bucket", "__before", "__index", "__phases")


def _before(sizes: DataFrame, span: int = 1000) -> DataFrame:
    """(__source, __bucket, __before) of counts by source and bucket: the rows of a source in its earlier buckets.

    Sums run over spans of buckets and inside each span, so no task holds all buckets of a source.
    """
    earlier = lambda column, order, *by: F.coalesce(F.sum(column).over(Window.partitionBy("__source", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__part", F.floor(F.col("__bucket") / span).cast("int"))
    parts = sizes.groupBy("__source", "__part").agg(F.sum("count").alias("count")).select("__source", "__part", earlier("count", "__part").alias("__first"))
    inside = sizes.withColumn("__inside", earlier("count", "__bucket", "__part"))
    return inside.join(parts, ["__source", "__part"]).select("__source", "__bucket", (F.col("__first") + F.col("__inside")).alias("__before"))


def _slot_of(plan: list[dict], source: str, block: int) -> int:
    for p in reversed(plan):
        if source in p["done"] and block >= p["done"][source]:
            w, i = p["weights"][source], block - p["done"][source]
            return p["slot"] + i // w * p["length"] + p["places"][source][i % w]
    raise ValueError(f"{source} has no block {block}")


def _courses(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """A row for each source with its phases; so of as many rows as the weights name sources, and one."""
    rows: dict[str, list[tuple]] = {}
    for p in plan:
        for s, first in p["done"].items():
            rows.setdefault(s, []).append((first, p["slot"], p["weights"][s], p["length"], p["places"][s]))
    kind = "__source string, __phases array<struct<first:long,slot:long,weight:long,length:long,places:array<int>>>"
    return spark.createDataFrame(list(rows.items()), kind)


def _slot() -> Column:
    """The slot of __block: by the last phase whose first block isn't beyond it."""
    p = F.element_at(F.filter("__phases", lambda x: x["first"] <= F.col("__block")), -1)
    return F.transform(F.array(p), lambda x: x["slot"] + F.floor((F.col("__block") - x["first"]) / x["weight"]) * x["length"] + x["places"][((F.col("__block") - x["first"]) % x["weight"]).cast("int")])[0]


#: Target weights of the sample corpus: three tiers.
TARGET = {f"src{i}": (30 if i == 0 else 20 if i < 5 else 10 if i < 12 else 5) for i in range(20)}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and place of every document in the mix by TARGET."""
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "source"), TARGET)
    return rows.select("doc_id", F.col("__source").alias("source"), F.col("__block").cast("long").alias("block"), F.col("__slot").cast("long").alias("slot"), F.col("__place").alias("place"))
