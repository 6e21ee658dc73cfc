"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Rows of one vector are a class, which counts its rows and is compared once. Normalised vectors are hashed by quantised
Gaussian projections into several tables. Each bucket is checked whole by cosine in double precision; a pair that meets in
several tables counts in the first one only. A bucket beyond a bound is dealt to blocks, and every pair of its blocks is a unit
of its own. Units return counts and a spanning forest, never pairs.

Projections are whole numbers and their sums are exact in doubles, so a vector's hashes are the same wherever they are worked out: a row carries
none of them, and only the ends of links get those of the tables before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import apart, cut, grouped, ship, table
from keelson.llm.graph import components, forest
from keelson.llm.topk import usable

LINKS = "node long, n long, hub long"
SCALE = 1 << 20  # of components and of draws as whole numbers


def collision(distance: float, width: float) -> float:
    """Probability that two points at a distance share one quantised Gaussian projection of a width."""
    t = width / distance
    return 1 - 2 * NormalDist().cdf(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, recall: float, bucket: int, width: float) -> tuple[int, int]:
    """Projections in a table, so that unrelated vectors fill buckets of about the given size, and tables for the recall at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(2.0, n / bucket)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; zero rows stay zero."""
    rows = rows.astype(np.float64)
    top = np.abs(rows).max(axis=1, initial=0, keepdims=True)
    rows = np.divide(rows, top, out=np.zeros_like(rows), where=top > 0)
    length = np.sqrt(np.square(rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class Family:
    """Hashes of vectors of one length: `tables` of k quantised projections each."""

    def __init__(self, d: int, k: int, tables: int, width: float, seed: int):
        r = np.random.default_rng([seed, d])
        self.d, self.k = d, k
        self.draws = np.rint(r.standard_normal((d, k * tables)) * SCALE)
        self.shift = np.rint(r.uniform(0, width, k * tables) * SCALE * SCALE)
        self.width = np.rint(width * SCALE * SCALE)
        self.mix = r.integers(1, 2**62, k, dtype=np.int64) | 1

    def keys(self, rows: np.ndarray, first: int, last: int) -> np.ndarray:
        """Buckets of rows of length 1 in the tables from first to last; sums of up to 2**12 products stay below 2**53."""
        at = slice(first * self.k, last * self.k)
        sums = np.rint(rows * SCALE) @ self.draws[:, at] + self.shift[at]
        cells = np.floor(sums / self.width).astype(np.int64).reshape(len(rows), last - first, self.k)
        with np.errstate(over="ignore"):
            keys = (cells * self.mix).sum(axis=2) ^ (self.d << 40)
            keys = (keys ^ (keys >> 31)) * np.int64(0x7FB5D329728EA185)
        return keys ^ (keys >> 29)


@lru_cache(maxsize=8)
def _family(d: int, k: int, tables: int, width: float, seed: int) -> Family:
    return Family(d, k, tables, width, seed)


def _place(family, kind: str, tables: int):
    """A row for each class and table, with the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                rows = np.ascontiguousarray(flat[(offsets[at][:, None] + np.arange(d)).ravel()].reshape(-1, d), kind)
                keys = family(int(d)).keys(unit(rows), 0, tables)
                raw = pa.array([x.tobytes() for x in rows], pa.binary())
                nodes, copies = (batch.column(c).take(pa.array(at)) for c in ("node", "copies"))
                for t in range(tables):
                    slot = pa.array(np.full(len(at), t, np.int32))
                    yield pa.RecordBatch.from_arrays([slot, pa.array(keys[:, t]), nodes, copies, raw], names=["slot", "bucket", "node", "copies", "raw"])

    return run


def _check(cosine: float, family, kind: str, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["slot", "bucket", "one", "two"]):
            if group.num_rows < 2:
                continue
            slot, one, two = (group.column(c)[0].as_py() for c in ("slot", "one", "two"))
            ids, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
            raw = group.column("raw").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            for at in (np.flatnonzero(sizes == size) for size in np.unique(sizes)):  # lengths may share a bucket by chance
                rows = unit(np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(len(at), -1))
                ones, twos = [], []
                for s in range(0, len(at), step):
                    x, y = np.nonzero(rows[s : s + step] @ rows[s:].T >= cosine)
                    x, y = x + s, y + s
                    fit = (x < y) & ((block[at[x]] != block[at[y]]) if one != two else True)
                    ones.append(x[fit])
                    twos.append(y[fit])
                a, b = np.concatenate(ones), np.concatenate(twos)
                if not len(a):
                    continue
                if slot:
                    ends, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                    keys = family(rows.shape[1]).keys(rows[ends], 0, slot)
                    p, q = np.split(where, 2)
                    new = np.ones(len(a), bool)
                    for s in range(0, len(a), 1 << 16):
                        new[s : s + (1 << 16)] = ~(keys[p[s : s + (1 << 16)]] == keys[q[s : s + (1 << 16)]]).any(axis=1)
                    a, b = a[new], b[new]
                n = copies[at]
                count = np.bincount(a, weights=n[b], minlength=len(at)) + np.bincount(b, weights=n[a], minlength=len(at))
                hub, some = forest(len(at), a, b), count > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][some]), pa.array(count[some].astype(np.int64)), pa.array(ids[at][hub[some]])], names=["node", "n", "hub"])

    return run


def blocked(rows: DataFrame, keys: list[str], id_column: str, most: int) -> DataFrame:
    """Give each row its block and the pairs of blocks (one <= two) in which it meets the others of its key.

    A key of up to most rows is one block. A larger one is dealt by hash to as many as it
    needs, and its rows are repeated for each block they have to meet.
    """
    sizes = rows.groupBy(*keys).count().where(F.col("count") > most)
    alone = F.lit(0)
    if sizes.isEmpty():
        return rows.select("*", alone.alias("block"), alone.alias("one"), alone.alias("two"))
    sizes = sizes.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    return deal(rows.join(sizes, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), id_column)


def deal(rows: DataFrame, id_column: str) -> DataFrame:
    """Deal rows to the number of blocks that `blocks` says, and repeat each for the blocks it has to meet."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(id_column, F.lit(17)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "blocks")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, bucket: int = 192, width: float = 2.0, most: int = 2048, seed: int = 11) -> DataFrame:
    """Links of each row of vectors (vec_id, vector) to the other rows at a cosine of at least the threshold.

    Returns vec_id, n_links, component_id, kept, a row for each of the input. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, neither do those of another length or with a null vec_id, which get
    their vec_id as component. Rows that repeat a vec_id are vectors of their own. recall is the chance to find a pair right at the threshold; nearer ones are surer.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = {"float": "f4"}.get(vectors.schema["vector"].dataType.elementType.simpleString(), "f8")
    zero = lambda x: x == 0
    fit = F.col("vec_id").isNotNull() & usable(F.col("vector")) & ~F.forall("vector", zero)
    prints = [F.xxhash64("vector").alias("one_print"), F.xxhash64(F.lit(29), "vector").alias("two_print")]
    names = ["one_print", "two_print"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    # numbers of a written table's rows are the same whenever it is read
    made = rows.where(fit).select("vec_id", "vector", *prints).groupBy(*names, "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = cut(made).withColumn("node", F.monotonically_increasing_id())
    n = classes.count()
    k, tables = plan(n, cosine, recall, bucket, width)

    family = partial(_family, k=k, tables=tables, width=width, seed=seed)
    placed = classes.select("node", "copies", "vector").mapInArrow(_place(family, kind, tables), "slot int, bucket long, node long, copies long, raw binary")
    units = blocked(placed, ["slot", "bucket"], "node", most)
    keys = ["slot", "bucket", "one", "two"]
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // 200_000)
    found = cut(units.repartition(spread, *keys).sortWithinPartitions(*keys).mapInArrow(_check(cosine, family, kind), LINKS))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    known = parts.join(classes.select("node", "least"), "node")
    known = known.join(known.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", "first")
    verdict = classes.select(*names, "node", "least", "copies").join(linked, "node", "left").join(known, "node", "left")
    links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    verdict = verdict.select(*(apart(F.col(c)).alias(f"{c}_") for c in names), links.alias("links"), F.coalesce("first", "least").alias("first"))
    own = rows.select("vec_id", *(F.when(fit, p).alias(c) for p, c in zip(prints, names, strict=True)))
    out = own.join(verdict, (F.col("one_print") == F.col("one_print_")) & (F.col("two_print") == F.col("two_print_")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all rows of embeddings, whatever their labels."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT u, w FROM p UNION SELECT reach.u, p.w FROM reach JOIN p ON reach.w = p.u),
c AS (SELECT u, min(w) AS m FROM reach GROUP BY u), d AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN d ON d.u = vec_id"""
