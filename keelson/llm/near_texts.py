"""N-gram Jaccard join of texts by a MinHash LSH forest, with exact verification.

Texts of one shingle set are a class and a node of its own. Every node gets a label in each tree: the values of its
MinHash signature there. Labels are range-sorted over the cluster, so a tree's trie lies in order and a crowded branch
spreads over partitions. Nodes of a run, which share a prefix, are tied if sketches of their signatures don't rule the similarity out; a tie
keeps the length of its prefix.

Matched prefixes start as full labels. What they find is verified, which tells the similarities of the links; each link
stands for those like it that labels of this length miss. While the links found are a lesser part of this estimate than the target recall, prefixes
are shortened by one value and the groups that grow are verified again. In a group, shingle sets meet in
blocks of bounded size, where every pair is checked by exact Jaccard. Units return counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import apart, cut, few, grouped, ship, slices, table
from keelson.llm.graph import components, forest
from keelson.llm.near_vectors import deal
from keelson.llm.words import Words, mix

TREES, DEEPEST = 32, 8  # labels of 16-bit values
SHORTEST = 5  # values of the shortest prefix that the trie's runs are read for
RECALL = 0.9999
WIDE = 1 << 15  # rows of a run that are compared by sketches; those of a longer one are all tied
BLOCK_BYTES, BLOCK = 1 << 21, 512  # shingles, and nodes, that a block of a group holds
BINS = 64  # of similarities from the threshold to 1


def found_share(similarity: float, depth: int) -> float:
    """Chance that a pair of a similarity shares a prefix of so many values in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def recall_of(bins: dict[int, int], similarity: float, depth: int) -> float:
    """Links found as a share of all that there are, if each stands for those of its similarity; bins: links by similarity."""
    low = {b: similarity + (1 - similarity) * b / BINS for b in bins}
    return sum(bins.values()) / max(1e-9, sum(n / found_share(low[b], depth) for b, n in bins.items())) if bins else 1.0


def most_bits(similarity: float, bits: int = TREES * DEEPEST) -> int:
    """Bits in which the sketches of a pair at the similarity differ at most, five standard deviations above the mean."""
    p = (1 - similarity) / 2
    return math.floor(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its runs of n words; one of all its words if it has fewer; none without words."""
    words = Words(texts, digits=True)
    h = words.hashes()
    cuts = np.searchsorted(words.doc, np.arange(words.n + 1))
    rolled = np.zeros(max(0, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            part = h[j:] * np.uint64(pow(0x9FB21C651E98DF25, j + 1, 2**64) | 1)
            rolled[: len(part)] += part
        rolled = mix(rolled)
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                weights = np.array([pow(0xD1B54A32D192ED03, j + 1, 2**64) | 1 for j in range(b - a)], np.uint64)
                out.append(mix(np.array([(h[a:b] * weights).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(77)
    return (draw.integers(1, 2**32, size, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), draw.integers(0, 2**32, size, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 256) -> np.ndarray:
    """The least value of each hash function over a set; its lower 16 bits, as the upper ones are alike for large sets."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for s in range(0, len(x), step):
            np.minimum(low, (x[s : s + step, None] * a + b).min(axis=0), out=low)
    return low.astype(np.uint16).astype(">u2")


def sketch(values: np.ndarray) -> bytes:
    """A bit of each value of a signature."""
    return np.packbits(values >= 1 << 15).tobytes()


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        one = mix(shingles * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        two = mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


FEATURES = "doc_id long, text_hash long, one_print long, two_print long, n_shingles int, labels binary, sketch binary"


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(TREES * DEEPEST)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                prints, values = [fingerprint(s) for s in sets], [signature(s, a, b) for s in sets]
                made = [[p for p, _ in prints], [p for _, p in prints], [len(s) for s in sets], [v.tobytes() for v in values], [sketch(v) for v in values]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *map(pa.array, made, kinds)], names=["doc_id", "text_hash", "one_print", "two_print", "n_shingles", "labels", "sketch"])

    return run


def close(sketches: np.ndarray, bits: int, step: int = 256) -> np.ndarray:
    """For each of some sketches (rows of 64-bit words) the first one that it reaches over pairs which differ in so many bits at most."""
    n = len(sketches)
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        root[left[0]], todo, left = left[0], left[:1], left[1:]
        while len(todo) and len(left):
            now, todo = todo[:step], todo[step:]
            met = (np.bitwise_count(sketches[now][:, None] ^ sketches[left]).sum(axis=2, dtype=np.int16) <= bits).any(axis=0)
            root[left[met]] = root[now[0]]
            todo, left = np.concatenate([todo, left[met]]), left[~met]
    return root


class Run:
    """Ties of the nodes of one run by the prefixes that they share, from full labels to the shortest."""

    def __init__(self, bits: int):
        self.bits = bits
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.depth: list[np.ndarray] = []

    def add(self, nodes: np.ndarray, common: np.ndarray, sketches: np.ndarray | None) -> None:
        """common: values that a row's label shares with the one before; without sketches all nodes of a prefix are tied."""
        root = np.arange(len(nodes))
        for depth in range(DEEPEST, SHORTEST - 1, -1):
            if not (common[1:] == depth).any():
                continue
            cuts = np.flatnonzero(np.concatenate([[True], common[1:] < depth, [True]]))
            now = np.empty_like(root)
            for a, b in zip(cuts, cuts[1:], strict=False):
                tied = sketches is None or b - a == 1 or b - a > WIDE
                now[a:b] = a + (0 if tied else close(sketches[a:b], self.bits))
            each = np.arange(len(nodes))  # what was tied before stays so
            now = forest(len(nodes), np.concatenate([each, each]), np.concatenate([now, root]))
            new = np.flatnonzero((now != root) & (root == each))
            self.u.append(nodes[root[new]])
            self.v.append(nodes[now[new]])
            self.depth.append(np.full(len(new), depth, np.int32))
            root = now

    def batch(self, ends: list[tuple[bytes, int]], part: int) -> pa.RecordBatch:
        u, v, depth = (np.concatenate([*x, np.zeros(0, k)]) for x, k in ((self.u, np.int64), (self.v, np.int64), (self.depth, np.int32)))
        self.u, self.v, self.depth = [], [], []
        n, k = len(u), len(ends)
        own = np.array([d for _, d in ends], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([u, own])), pa.array(np.concatenate([v, own])), pa.array(np.concatenate([depth, np.zeros(k, np.int32)])), pa.array([None] * n + [x for x, _ in ends], pa.binary()), pa.array([None] * n + [part] * k, pa.int32())],
            names=["u", "v", "depth", "edge", "part"],
        )


def shared_values(one: bytes, two: bytes) -> int:
    """Values that two labels share from their beginning, by tree and label; 0 for different trees."""
    if one[:1] != two[:1]:
        return 0
    return next((i for i in range(DEEPEST) if one[1 + 2 * i : 3 + 2 * i] != two[1 + 2 * i : 3 + 2 * i]), DEEPEST)


def _match(bits: int):
    """Over sorted (tree, label and sketch, node): tie the nodes of every run; and tell a partition's first and last rows.

    A run that touches an end of the partition may go on beyond, so all its nodes are tied.
    """
    width = 2 * DEEPEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties, first, last = Run(bits), None, None
        held: list[tuple] = []  # of the run that may go on: nodes, values in common, sketches
        outer = True  # the run held, or the next one, is the partition's first

        def flush(touches: bool) -> None:
            if sum(len(x[0]) for x in held) > 1:
                nodes, common, sketches = (np.concatenate(x) for x in zip(*held, strict=True))
                ties.add(nodes, common, None if touches else sketches)
            held.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label = batch.column("label")
            begin = np.frombuffer(label.buffers()[1], np.int32)[label.offset]
            size = width + TREES * DEEPEST // 8
            data = np.frombuffer(label.buffers()[2], np.uint8)[begin : begin + n * size].reshape(n, size)
            keys = np.concatenate([batch.column("tree").to_numpy()[:, None].astype(np.uint16), np.ascontiguousarray(data[:, :width]).view(np.uint16)], axis=1)
            sketches, nodes = np.ascontiguousarray(data[:, width:]).view(np.uint64), batch.column("node").to_numpy()
            ends = [(bytes([int(keys[i, 0])]) + data[i, :width].tobytes(), int(nodes[i])) for i in (0, n - 1)]
            differ = np.concatenate([keys[1:] != keys[:-1], np.ones((n - 1, 1), bool)], axis=1).argmax(axis=1)
            common = np.concatenate([[shared_values(last[0], ends[0][0]) if last else 0], np.maximum(differ - 1, 0)])
            first, last = first or ends[0], ends[1]
            part = lambda a, b: (nodes[a:b], common[a:b], sketches[a:b])  # noqa: B023, E731
            starts = np.flatnonzero(common < SHORTEST)
            if not len(starts) or starts[0]:
                held.append(part(0, starts[0] if len(starts) else n))
            if not len(starts):
                continue
            if held:
                flush(outer)
                outer = False
            stops = np.append(starts[1:], n)
            held.append(part(starts[0], stops[0]))
            if len(starts) > 1:
                flush(outer)
                outer = False
                inner = np.flatnonzero(stops[1:-1] - starts[1:-1] > 1) + 1  # a run of one row has no ties
                for a, b in zip(starts[inner], stops[inner], strict=True):
                    ties.add(*part(a, b))
                held.append(part(starts[-1], n))
            if sum(map(len, ties.u)) > 50_000:
                yield ties.batch([], 0)
        flush(True)
        yield ties.batch([first, last] if first else [], TaskContext.get().partitionId())

    return run


def ties(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, depth) over nodes (node, labels, sketch): ties of nodes whose labels share prefixes of that many values in some tree."""
    spark = nodes.sparkSession
    placed = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels", "sketch")
    label = F.concat(F.substring("labels", F.col("tree") * 2 * DEEPEST + 1, F.lit(2 * DEEPEST)), F.col("sketch"))
    placed = placed.select("node", F.col("tree").cast("byte").alias("tree"), label.alias("label"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TREES // 2_000_000)
    trie = placed.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = cut(trie.mapInArrow(_match(most_bits(similarity)), "u long, v long, depth int, edge binary, part int"))
    # a run that goes on in the next partition: two rows of each partition, so no more than the partitions
    first: dict[int, tuple] = {}
    last: dict[int, tuple] = {}
    for part, key, node in found.where(F.col("edge").isNotNull()).select("part", "edge", "u").collect():
        first.setdefault(part, (bytes(key), node))
        last[part] = (bytes(key), node)
    order = sorted(first)
    over = [(first[b][1], last[a][1], shared_values(first[b][0], last[a][0])) for a, b in zip(order, order[1:], strict=False)]
    over = [x for x in over if x[2] >= SHORTEST]
    edges = found.where(F.col("edge").isNull()).select("u", "v", "depth")
    return edges.unionByName(spark.createDataFrame(over, "u long, v long, depth int")) if over else edges


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.drop_columns(["text"]).append_column("shingles", pa.array([s.tobytes() for s in shingle_sets(part.column("text"), n)], pa.binary()))

    return run


def overlaps(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by matrix products over the shingles that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[at] > 1
    number = np.cumsum(seen > 1) - 1
    row, col = owner[keep], number[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [s, s + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[a:b], col[a:b] - s] = 1
        out += m @ m.T
    return out


def _verify(ratio: Fraction):
    """Of groups of blocks: the links of each node and a node that it reaches; and, with a bin, the pairs by similarity, told of one of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["component", "one", "two"]):
            one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
            ids = group.column("node").to_numpy()
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
            size = np.array([len(s) for s in sets])
            shared = overlaps(sets)
            near = shared * (ratio.numerator + ratio.denominator) >= ratio.numerator * (size[:, None] + size)
            near &= (block[:, None] != block) if one != two else True
            np.fill_diagonal(near, False)
            count = near @ copies
            a, b = np.nonzero(np.triu(near))
            if not len(a):
                continue
            hub, some = forest(len(ids), a, b), count > 0
            alike = shared[a, b] / (size[a] + size[b] - shared[a, b])
            low = float(ratio)
            bins = np.bincount(np.clip(((alike - low) / max(1e-9, 1 - low) * BINS).astype(np.int64), 0, BINS - 1))
            full = np.flatnonzero(bins)
            columns = [np.concatenate([ids[some], np.full(len(full), ids[a[0]])]), np.concatenate([count[some].astype(np.int64), bins[full]]), np.concatenate([ids[hub[some]], np.full(len(full), ids[a[0]])])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * int(some.sum()) + full.tolist(), pa.int32())], names=["node", "n", "hub", "bin"])

    return run


LINKS = "node long, n long, hub long, bin int"


def _links(rows: DataFrame, groups: DataFrame, classes: DataFrame, n: int, similarity: str, repeated: bool) -> DataFrame:
    """Verified links within groups (node, component) of classes; rows: (doc_id, text_hash, text), and whether some of them repeat both."""
    named = classes.select("node", "rep", "copies", "n_shingles").join(groups, "node")
    blocks = F.ceil(F.greatest(F.sum("n_shingles") * 8 / BLOCK_BYTES, F.count("*") / BLOCK)).cast("int")
    sizes = groups.join(classes.select("node", "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("count"), blocks.alias("blocks")).where(F.col("count") > 1)
    sizes = few(sizes.select(apart(F.col("component")).alias("key"), "blocks"))
    asked = cut(named.join(sizes, F.col("component") == F.col("key")).select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("hash"), "node", "component", "blocks", "copies"))
    # the texts of candidates only, by the shuffle of one join
    met = rows.where(F.col("doc_id").isNotNull()).join(asked.withColumnRenamed("doc_id", "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("hash")))
    met = met.select("node", "component", "blocks", "copies", "text")
    met = met.dropDuplicates(["node"]) if repeated else met
    sets = met.mapInArrow(_sets(n), "node long, component long, blocks int, copies long, shingles binary")
    keys = ["component", "one", "two"]
    units = deal(sets, "node").repartition(*keys).sortWithinPartitions(*keys)
    return units.mapInArrow(_verify(Fraction(similarity)), LINKS)


def near_texts(documents: DataFrame, n: int = 5, similarity: str = "0.8", recall: float = RECALL) -> DataFrame:
    """For each row of documents (doc_id, text): doc_id, text_hash, class_id, n_links, copies, kept.

    Words are lower-case runs of letters and digits; a text of fewer than n words has one shingle of all of
    them; a text without words (null and empty ones too) is a class of its own and has no links. n_links counts the other rows at a
    Jaccard similarity of at least the threshold, copies included. class_id is the least
    doc_id reachable by links, itself included. Rows with a null doc_id take no part. kept: the row is the first of its class by doc_id and
    then text_hash, or takes no part; rows that repeat a doc_id with another text are documents of their own, and rows
    that repeat both are alike, so all of them are kept or none. recall: the share of all links to find, as estimated from those found.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    features = cut(rows.mapInArrow(_features(n), FEATURES))
    prints = ["one_print", "two_print", "n_shingles"]
    full = features.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    # numbers of a written table's rows are the same whenever it is read
    classes = cut(full.groupBy(*prints).agg(first, F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))).withColumn("node", F.monotonically_increasing_id())
    edges = ties(classes.select("node", "labels", "sketch"), float(similarity))
    repeated = not full.groupBy("doc_id", "text_hash").count().where(F.col("count") > 1).isEmpty()
    links = groups = None
    for depth in range(DEEPEST, SHORTEST - 1, -1):
        now = cut(components(edges.where(F.col("depth") >= depth)))
        if links is None:
            links = cut(_links(rows, now, classes, n, similarity, repeated))
        else:
            # groups that nothing joined are verified already
            was = now.join(groups.select("node", F.col("component").alias("was")), "node", "left").withColumn("was", F.coalesce("was", "node"))
            grown = was.groupBy("component").agg(F.min("was").alias("low"), F.max("was").alias("high")).where(F.col("low") != F.col("high"))
            grown = few(grown.select(apart(F.col("component")).alias("key")))
            changed = cut(now.join(grown, F.col("component") == F.col("key"), "left_semi"))
            if not changed.isEmpty():
                rest = links.join(changed.select("node"), "node", "left_anti").select("node", "n", "hub", "bin")
                links = cut(rest.unionByName(_links(rows, changed, classes, n, similarity, repeated)))
        groups = now
        bins = dict(links.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.sum("n")).collect())  # BINS rows at most
        if recall_of(bins, float(similarity), depth) >= recall:
            break
    links = links.where(F.col("bin").isNull())
    linked = links.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(links.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    # a class's least row is the first of all rows that it reaches
    met = classes.select("node", "rep", "copies", *prints).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = met.join(joined.select("node"), "node", "left_semi").groupBy("component").agg(F.min("rep").alias("least"))
    least = few(least.select(apart(F.col("component")).alias("key"), "least"))
    verdict = met.join(linked, "node", "left").join(least, F.col("component") == F.col("key"), "left")
    verdict = verdict.select(*prints, F.coalesce("least", "rep").alias("first"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = full.select("doc_id", "text_hash", *prints).join(verdict, prints)
    kept = F.struct("doc_id", "text_hash") == F.col("first")
    out = out.select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "n_links", "copies", kept.alias("kept"))
    alone = features.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    alone = alone.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, on shingles of five words at a similarity of 0.8 or more."""
    return near_texts(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 5 * c >= 4 * (x.k + y.k - c)),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS least FROM r GROUP BY u), d AS (SELECT u, count(*) AS links FROM l GROUP BY u)
SELECT doc_id, least(doc_id, coalesce(m.least, doc_id)) AS class_id, coalesce(links, 0) AS n_links, doc_id = least(doc_id, coalesce(m.least, doc_id)) AS kept
FROM documents LEFT JOIN m ON m.u = doc_id LEFT JOIN d ON d.u = doc_id"""
