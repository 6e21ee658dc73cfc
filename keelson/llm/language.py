"""Language identification with spans of mixed-language text.

The script of a word's letters narrows the languages that may claim it; letter trigrams,
counted over all training documents into a table of fixed size, score it in each of
them. Viterbi over the words with a penalty for each switch labels the spans. Where two bounds show that
no other path beats the one that stays in the leading language, that one is taken at once; else the table of states is filled word by word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import extended, shielded, ship, slices, table
from keelson.llm.toxicity import held_out
from keelson.llm.words import Words, mix

BITS = 17  # of a hashed trigram
SMOOTH = 0.1
PENALTY = 12.0  # nats that a switch of language costs
LEAST_SHARE = 0.002  # of a language's letters that a script needs to be one of its scripts
UNKNOWN = "und"
#: First code points of script ranges and the scripts that begin there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x31A0, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({s for _, s in SCRIPTS})


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    starts = [a for a, _ in SCRIPTS]
    blocks = np.array([NAMES.index(SCRIPTS[bisect_right(starts, i << 4) - 1][1]) for i in range(0x11000)], np.int8)
    out = np.repeat(blocks, 16)
    for (a, s), (b, _) in zip(SCRIPTS, SCRIPTS[1:] + [(0x110000, "")], strict=True):
        out[a : min(b, (a | 15) + 1)] = NAMES.index(s)
    return out


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The letters' places in the texts, and for each the hashed trigram around it; a word is framed by blanks."""
    lengths = words.end - words.start
    at = np.arange(int(lengths.sum())) + np.repeat(words.start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    c = np.zeros(len(words.chars) + 2, np.uint64)
    c[1:-1] = words.chars
    edge = np.zeros(len(words.chars) + 1, bool)
    edge[words.start] = True
    left = np.where(edge[at], np.uint64(0), c[at])
    edge[:] = False
    edge[words.end - 1] = True
    right = np.where(edge[at], np.uint64(0), c[at + 2])
    with np.errstate(over="ignore"):
        cells = mix((left << np.uint64(42)) ^ (c[at + 1] << np.uint64(21)) ^ right) * np.uint64(0x9E3779B97F4A7C15)
    return at, (cells >> np.uint64(64 - BITS)).astype(np.int64)


def _count(langs: list[str]):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BITS) + len(NAMES)
        total = np.zeros(len(langs) * size, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                lang = np.array([index.get(x, -1) for x in part.column("lang").to_pylist()])
                at, cells = _trigrams(words)
                of = np.repeat(lang[words.doc], words.end - words.start)
                keep = of >= 0
                for cell in (cells, _script_table()[words.chars[at]].astype(np.int64) + (1 << BITS)):
                    total += np.bincount(of[keep] * size + cell[keep], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    return run


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, : 1 << BITS], counts[:, 1 << BITS :]
        whole = grams.sum(axis=1, keepdims=True) + SMOOTH * (1 << BITS)
        self.logs = np.ascontiguousarray(np.log((grams + SMOOTH) / whole).T.astype(np.float32))
        self.scripts = scripts >= np.maximum(1, LEAST_SHARE * scripts.sum(axis=1, keepdims=True))

    def word_scores(self, words: Words) -> np.ndarray:
        """Log-likelihood of each word in each language, lower by far where its script isn't one of the language's."""
        at, cells = _trigrams(words)
        ends = np.cumsum(words.end - words.start)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.logs[cells], axis=0, dtype=np.float64)])
        scores = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        fits = self.scripts[:, _script_table()[words.chars[words.start]]].T
        barred = ~fits & fits.any(axis=1, keepdims=True)
        scores[barred] -= 4 * PENALTY
        return scores


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The state of each step on the path of the highest sum of scores less penalties for switches.

    Ties go to the path that stays in the leading state (of the highest sum, the lowest of equals), else to lower states. A path
    that visits the leading state has a switch for every segment in another one, so it wins nothing if no such segment
    gains more than the penalty; one that never visits it has a switch less than segments, and gains at most the best other state at every step.
    """
    n, k = scores.shape
    if not n or k == 1:
        return np.zeros(n, np.int64)
    lead = int(scores.sum(axis=0).argmax())
    step = scores - scores[:, [lead]]
    others = np.delete(step, lead, axis=1)
    gain = np.cumsum(others, axis=0)
    low = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((1, k - 1)), gain[:-1]])), 0)
    if float((gain - low).max()) <= penalty and float(others.max(axis=1).sum()) <= penalty:
        return np.full(n, lead)
    back = np.empty((n, k), np.int32)
    best = scores[0].copy()
    stay = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty > best
        back[i] = np.where(switch, top, stay)
        best = np.where(switch, best[top] - penalty, best) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def train(rows: DataFrame) -> Model:
    """A model from rows (text, lang) with a lang; it holds one column of a fixed length for each language."""
    ship(rows.sparkSession)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(x for (x,) in rows.select("lang").distinct().collect())
    size = (1 << BITS) + len(NAMES)
    counts = np.zeros(max(1, len(langs)) * size)
    if langs:
        got = rows.mapInArrow(_count(langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return Model(langs or [UNKNOWN], counts.reshape(-1, size))


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def _label(shared, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                scores, length = model.word_scores(words), words.end - words.start
                cuts = np.searchsorted(words.doc, np.arange(words.n + 1))
                found: list[tuple] = []
                for i in range(words.n):
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    if a == b:
                        found.append((UNKNOWN, 0.0, []))
                        continue
                    path = viterbi(scores[a:b], penalty)
                    letters = np.bincount(path, weights=length[a:b], minlength=len(model.langs))
                    turns = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [b - a]])
                    spans = [{"start": int(words.start[a + s] - words.first[i]), "end": int(words.end[a + e - 1] - words.first[i]), "lang": model.langs[path[s]]} for s, e in zip(turns, turns[1:], strict=False)]
                    top = int(letters.argmax())
                    found.append((model.langs[top], float(letters[top] / letters.sum()), spans))
                for name, kind, column in zip(("__lang", "__share", "__spans"), (pa.string(), pa.float64(), pa.list_(SPAN)), zip(*found, strict=True), strict=True):
                    part = part.append_column(name, pa.array(column, kind))
                yield part

    return run


@shielded
def label_texts(rows: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """rows (with text and any other columns) with __lang, __share and __spans.

    __spans: code-point ranges of the lower-case text and their languages; __lang: the language of most
    letters (ties to the first by name), `und` for a text that is null or has no letter; __share: its share of the letters.
    Names that begin with two underscores are as common.shielded says.
    """
    spark = rows.sparkSession
    ship(spark)
    kinds = extended(rows, "__lang string, __share double, __spans array<struct<start:int,end:int,lang:string>>")
    return rows.mapInArrow(_label(spark.sparkContext.broadcast(model), penalty), kinds)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = label_texts(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__share").alias("score"), F.size("__spans").alias("n_spans"))
