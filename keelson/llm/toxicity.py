"""Toxicity by maximum-scoring segments over token log-odds.

Every word has log-odds of toxic against clean under a chain of Dirichlet priors: the classes' shares are the
prior of the word's 4-letter stem, that stem's posterior of the 6-letter stem, and that one's of the
word. Counts cover all labelled training rows; words are hashed, so the model has a fixed size.
A linear scan finds every maximal scoring segment of a text; the extreme-value law of
random segments gives each its expected number by chance, and a logistic curve over the
log of these evidences, fitted on a histogram, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import cut, extended, shielded, ship, slices, table
from keelson.llm.words import Words

STEMS = (4, 6, None)  # letters of the stems, from the widest class to the whole word
BITS = 19  # of a hashed stem
WEIGHT = 20.0  # documents that a prior counts for
SHIFT = 1.0  # taken from each token's log-odds, so that a random text drifts down
BINS, STEP = 2048, 0.05  # of histograms over scores and over evidences


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _cells(words: Words) -> list[np.ndarray]:
    return [(words.hashes(p) >> np.uint64(64 - BITS)).astype(np.int64) + (i << BITS) for i, p in enumerate(STEMS)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each hashed stem, by class; one sparse table for each task."""
    size = len(STEMS) << BITS
    total = np.zeros((2, size), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            words, toxic = Words(part.column("text")), part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for cells in _cells(words):
                once = np.unique(words.doc * size + cells)
                side = toxic[once // size]
                for c in (0, 1):
                    np.add.at(total[c], once[side == c] % size, 1)
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1, some]), pa.array(total[0, some])], names=["cell", "toxic", "clean"])


class Model:
    """Token scores, and the calibration once it is fitted."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int):
        self.toxic, self.clean = toxic.astype(np.float32), clean.astype(np.float32)
        self.base = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        self.rate, self.scale, self.curve = 1.0, 1.0, (0.0, 0.0)

    def scores(self, words: Words) -> np.ndarray:
        p = np.full(len(words.start), self.base)
        for cells in _cells(words):
            t, c = self.toxic[cells], self.clean[cells]
            p = (t + WEIGHT * p) / (t + c + WEIGHT)
        return np.log(p / (1 - p)) - math.log(self.base / (1 - self.base)) - SHIFT

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score that n random tokens hold by chance."""
        return self.scale * n * math.exp(-self.rate * score)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Minus the natural logs of the expected numbers of all segments that chance doesn't explain, summed."""
        return sum(-math.log(e) for _, _, s in found if (e := max(self.expected(s, n), 1e-300)) < 1)

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(evidence)))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Only positive entries are visited one by one. Each opens a candidate with the sums before
    and after it; a candidate is joined to the nearest earlier one that began lower, if that
    one also ended lower.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []  # start, end, sum before, sum after, nearest earlier candidate with a lower sum before
    for i in np.flatnonzero(scores > 0).tolist():
        now = [i, i + 1, sums[i], sums[i + 1], -1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= now[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= now[3]:
                now[4] = j
                kept.append(now)
                break
            now[0], now[2], j = kept[j][0], kept[j][2], _drop(kept, j)
    return [(a, b, float(y - x)) for a, b, x, y, _ in kept]


def _drop(kept: list[list], j: int) -> int:
    """Remove candidate j and all after it; returns the one that j pointed to."""
    back = kept[j][4]
    del kept[j:]
    return back


def _by_text(model: Model, texts: pa.Array) -> Iterator[tuple[Words, np.ndarray, int, int, list]]:
    words = Words(texts)
    scores = model.scores(words)
    cuts = np.searchsorted(words.doc, np.arange(words.n + 1))
    for i in range(words.n):
        a, b = cuts[i], cuts[i + 1]
        yield words, scores, int(a), int(b), segments(scores[a:b])


def _profile(model: Model, stage: str):
    """Histograms over training rows; stage null: token scores and segment scores of clean rows; stage curve: evidences by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                toxic = part.column("toxic").to_pylist()
                for label, (_, scores, a, b, found) in zip(toxic, _by_text(model, part.column("text")), strict=True):
                    if stage == "curve":
                        put = [(f"curve{label}", [math.log1p(model.evidence(found, b - a))])]
                    elif label:
                        continue
                    else:
                        put = [("token", scores[a:b] + BINS * STEP / 2), ("segment", [s for _, _, s in found])]
                    for name, values in put:
                        at = np.clip((np.asarray(values, float) / STEP).astype(np.int64), 0, BINS - 1)
                        total[name] = total.get(name, 0) + np.bincount(at, minlength=BINS)
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["name", "bin", "n"])

    return run


def _histogram(rows: DataFrame, model: Model, stage: str) -> dict[str, np.ndarray]:
    """Of at most a few thousand bins, so small enough for the driver."""
    out: dict[str, np.ndarray] = {}
    sums = rows.mapInArrow(_profile(model, stage), "name string, bin long, n long").groupBy("name", "bin").agg(F.sum("n").alias("n"))
    for name, at, n in sums.collect():
        out.setdefault(name, np.zeros(BINS))[at] = n
    return out


def _extreme_values(model: Model, tokens: np.ndarray, found: np.ndarray) -> None:
    """Rate and scale of the law: rate solves E[exp(rate * score)] = 1; scale fits the clean texts' own segments."""
    p = tokens / max(1.0, tokens.sum())
    value = (np.arange(BINS) + 0.5) * STEP - BINS * STEP / 2
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(np.minimum(mid * value, 600))) < 1 else (low, mid)
    model.rate = max(low, 0.05)
    above = np.cumsum(found[::-1])[::-1]
    at = int(np.searchsorted(-above, -max(1.0, 0.01 * found.sum())))  # scores that a hundredth of the segments reach
    model.scale = max(float(above[min(at, BINS - 1)]), 1.0) / max(1.0, tokens.sum()) * math.exp(model.rate * at * STEP)


def _curve(clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Ridge-damped logistic fit on the two histograms."""
    x = np.concatenate([(np.arange(BINS) + 0.5) * STEP] * 2)
    y, w = np.repeat([0.0, 1.0], BINS), np.concatenate([clean, toxic])
    m, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -40, 40)))
        grad = m.T @ (w * (y - p)) - 0.05 * beta
        step = np.linalg.solve((m * (w * p * (1 - p))[:, None]).T @ m + 0.05 * np.eye(2), grad)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0]), float(max(beta[1], 0.0))


def train(labelled: DataFrame) -> Model:
    """A model from rows (text, toxic 0 or 1); without any rows of a class every text scores below a half."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    rows = cut(rows)
    size = dict(rows.groupBy("toxic").count().collect())
    cells = rows.mapInArrow(_count, "cell long, toxic long, clean long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = cells.toArrow()  # at most a row for each cell of the fixed table
    counts = np.zeros((2, len(STEMS) << BITS))
    for i, c in enumerate(("clean", "toxic")):
        counts[i, got.column("cell").to_numpy()] = got.column(c).to_numpy()
    model = Model(counts[1], counts[0], size.get(1, 0), size.get(0, 0))
    none = np.zeros(BINS)
    seen = _histogram(rows, model, "null")
    _extreme_values(model, seen.get("token", none), seen.get("segment", none))
    seen = _histogram(rows, model, "curve")
    model.curve = _curve(seen.get("curve0", none), seen.get("curve1", none)) if size.get(1, 0) else (-5.0, 0.0)
    return model


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                score, passages = [], []
                for words, _, a, b, found in _by_text(model, part.column("text")):
                    score.append(model.probability(model.evidence(found, b - a)))
                    first = words.first[len(score) - 1]
                    passages.append([{"start": int(words.start[a + s] - first), "end": int(words.end[a + e - 1] - first), "expected": model.expected(v, b - a)} for s, e, v in found if model.expected(v, b - a) < 1])
                yield part.append_column("__score", pa.array(score, pa.float64())).append_column("__passages", pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))))

    return run


@shielded
def score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with text and any other columns) with __score and __passages.

    __passages: code-point ranges of the lower-case text of every segment that chance would give less than once,
    and how often it would. Null and empty texts have no passages and the score of no evidence.
    Names that begin with two underscores are as common.shielded says.
    """
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_apply(shared), extended(rows, "__score double, __passages array<struct<start:int,end:int,expected:double>>"))


def labelled_rows(documents: DataFrame, labels: DataFrame, most: int = 100_000) -> DataFrame:
    """Training rows (text, toxic): documents outside the held-out fifth, by their labels.

    Several labels of one document count once if they agree, else not at all. Beyond most
    labels a sample of them, chosen by a hash of doc_id, is used; so the label table that goes to
    every executor has a fixed bound.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    marks = marks.where(F.col("toxic") == F.col("other")).select("doc_id", "toxic")
    if (n := marks.count()) > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(most)
    return documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; learned from the labels of the documents that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = train(labelled_rows(documents, table(spark, sf_dir, "labels")))
    scored = score_texts(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
        F.size("__passages").alias("n_passages"),
    )
