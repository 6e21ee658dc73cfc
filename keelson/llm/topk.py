"""Exact top-k search by inner product over a vertical layout.

Candidates are dealt to groups of bounded size; a block of queries meets every group. In a
group the vectors lie dimension by dimension. Scores are accumulated over blocks of
dimensions; after each block the Cauchy-Schwarz bound on the remaining mass of query and
candidate drops the candidates that can't reach the k-th best score, and the survivors are
compacted. The best k of each group meet in one ranking for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import cut, ship, table

#: Largest magnitude below which sums of integers are exact in doubles, and in long integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**62
FOUND = "query_id long, query_row long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


class Vertical:
    """Integer vectors of one length, stored dimension by dimension."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray, block: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.numbers, columns = ids[order], numbers[order], np.ascontiguousarray(rows[order].T)
        self.dims = len(columns)
        self.cuts = list(range(0, self.dims, block)) + [self.dims]
        self.top = float(np.abs(columns).max(initial=0))
        self.exact = columns
        self.blocks = [columns[a:b].astype(np.float64) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        mass = np.cumsum(np.square(columns.astype(np.float64))[::-1], axis=0)[::-1]
        self.rest = [np.sqrt(mass[c]) if c < self.dims else np.zeros(len(ids)) for c in self.cuts[1:]]

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates, ties to the smaller id; the query's own row, by its number, takes no part."""
        most = max(1.0, float(np.abs(query).max(initial=0))) * max(1.0, self.top) * self.dims
        at = np.flatnonzero(self.numbers != own)
        if most >= EXACT_DOUBLE:
            scores = self._plain(query, at, most)
        else:
            at, scores = self._bounded(query.astype(np.float64), at, k)
        top = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][top], scores[top].astype(np.int64)

    def _plain(self, query: np.ndarray, at: np.ndarray, most: float) -> np.ndarray:
        if most < EXACT_LONG:
            return query.astype(np.int64) @ self.exact[:, at]
        low, high = -(2**63) + 1, 2**63 - 1
        wide = query.astype(object) @ self.exact[:, at].astype(object) if len(at) else []
        return np.array([min(max(int(x), low), high) for x in wide], dtype=np.int64)

    def _bounded(self, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [query[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        left = [math.sqrt(float(np.square(query[c:]).sum())) for c in self.cuts[1:]]
        sums, floor = (parts[0] @ self.blocks[0])[at], -math.inf
        for i in range(len(parts)):
            if i:
                sums = sums + parts[i] @ self.blocks[i][:, at]
            if len(at) <= k or i + 1 == len(parts):
                continue
            bound = sums + left[i] * self.rest[i][at] * (1 + 1e-9) + 1e-6
            if i == 0:  # the most promising candidates are scored in full and give a first floor
                first = at[np.argpartition(-bound, k - 1)[:k]]
                floor = min(sum(p @ b[:, first] for p, b in zip(parts, self.blocks, strict=True)))
            else:  # a partial score less the remaining mass is what a candidate reaches at least
                sure = sums - left[i] * self.rest[i][at] * (1 + 1e-9) - 1e-6
                floor = max(floor, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
            stay = bound >= floor
            at, sums = at[stay], sums[stay]
        return at, sums


def _search(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("dims").to_pylist(), batch.column("part").to_pylist(), batch.column("asks").to_pylist(), strict=True))
            vectors = batch.column("vector")
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            ids, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                dims, part, asks = keys[start]
                rows = flat[offsets[start] : offsets[i]].reshape(-1, dims)
                if key != (dims, part):
                    key, held, made = (dims, part), [], None
                if not asks:
                    held.append((ids[start:i], numbers[start:i], rows))
                elif held:
                    made = made or Vertical(*map(np.concatenate, zip(*held, strict=True)), block)
                    out += [(q, n, *made.best(v, n, k)) for q, n, v in zip(ids[start:i], numbers[start:i], rows, strict=True)]
                start = i
            if out:
                queries, own, found, scores = zip(*out, strict=True)
                sizes = [len(x) for x in found]
                columns = [np.repeat(queries, sizes), np.repeat(own, sizes), np.concatenate(found), np.concatenate(scores)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, block: int = 16, group_rows: int = 4096, most_rows: int = 1 << 19) -> DataFrame:
    """The k best candidates by integer inner product for each row of vectors (vec_id, vector of long) that queries selects.

    Every row is a vector of its own, also where it repeats an id, and a candidate for every query but itself; null ids take no part.
    Only vectors of one length are compared. Groups hold group_rows candidates, more (up to most_rows) where the cluster
    would have over eight groups a slot. Sums beyond a long are held at its limits. Returns
    query_id, rank from 1, vec_id, score; nothing for an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    # numbers of a written table's rows are the same whenever it is read
    rows = cut(rows).withColumn("row", F.monotonically_increasing_id())
    n = rows.count()
    size = min(most_rows, max(group_rows, n // (8 * spark.sparkContext.defaultParallelism)))
    parts = max(1, math.ceil(n / size))
    rows = rows.withColumn("dims", F.size("vector"))
    deal = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    candidates = rows.select("dims", deal.alias("part"), F.lit(False).alias("asks"), "vec_id", "row", "vector")
    asked = rows.where(queries).select("dims", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "vec_id", "row", "vector")
    met = candidates.unionByName(asked).repartition(max(parts, 1), "dims", "part").sortWithinPartitions("dims", "part", "asks")
    found = met.mapInArrow(_search(k, block), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of embeddings for each row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    scaled = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("vector"))
    return top_k(scaled, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
