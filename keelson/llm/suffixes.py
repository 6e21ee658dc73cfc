"""Removal of byte passages that occur more than once, by column-wise suffix sorting.

All windows of `least` bytes are compared, those of whole texts and within one text too:

1. Windows in a row that share their minimiser (the window's sub-string of least hash) form a
   segment; equal windows have equal minimisers at equal offsets. Counting minimisers
   settles most segments: one that is alone has no repeat, and if all of a minimiser's segments are equal and more than one, all repeat.
   Segments are equal if their 128-bit BLAKE2 digests are, and so are the cores below.
2. The distinct segments of the other minimisers are cut into bands of neighbouring windows.
   All windows of a band hold one core, so segments meet by band and core.
3. In such a group only what surrounds the core differs. With the core as one symbol, the suffixes
   of these strings are sorted column by column, and common prefixes tell which windows repeat.

A core that more strings surround than one task should sort is parted: bands are halved, so the
core grows by what must be equal, until no group is too large or each window stands alone.

Strings in a group have at most 2 * BAND - 1 symbols however long the texts are. Steps 1 and
2 only deal windows to groups in which all their equals must be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.columnwise import repeated
from keelson.llm.common import apart, cut, extended, few, grouped, shielded, ship, slices, table
from keelson.llm.words import mix

LEAST, GRAM, BAND = 400, 128, 32
BLOCK = 1 << 20  # starts that are hashed at a time
CHUNK = 16_384  # strings that are sorted together
CROWD = 2_000  # strings around one core that one task sorts; beyond that they are parted by their surroundings
CORE = 257  # the symbol of a core; bytes are 1 to 256
CODE = 6  # bytes of a word's code
PASSAGE_GRAM = 80  # GRAM for windows of codes
NULL_ID = -(2**63)


def _draw(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Polynomial hashes modulo 2**64 of any sub-strings of a byte array. They deal strings to groups; none stands for equality."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, size: int):
        base = self.BASE
        self.code = _draw(41)
        with np.errstate(over="ignore"):
            power = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, np.uint64))])
            self.up, self.down = power(base), power(np.uint64(pow(int(base), -1, 2**64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.code[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.down[start])


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of the least one, the first of equals (by their upper 40 bits)."""
    n = len(grams)
    keys = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    keys[:n] = (grams & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(n, dtype=np.uint64)
    rows = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    runs = n - width + 1
    return (np.minimum(behind[:runs], ahead[width - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests of sub-strings of a byte array, as two whole numbers each."""
    view, make = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    found = b"".join([make(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins; the end comes last."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


SEGMENTS = "minimiser long, content_a long, content_b long, id long, print long, start int, windows int, offset int"


def _segments(least: int, gram: int, code=iter):
    width = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BLOCK + least)
        for batch in code(batches):
            if not batch.num_rows:
                continue
            data, at = _bytes(batch.column("data"))
            ids, prints = batch.column("id").to_numpy(), batch.column("print").to_numpy()
            for s in range(0, len(data) - least + 1, BLOCK):
                part = data[s : s + BLOCK + least - 1]
                starts = np.arange(len(part) - gram + 1)
                grams = rolling.of(rolling.sums(part), starts, starts + gram)
                place = minimisers(grams, width)
                # windows within one text only
                low, high = np.searchsorted(at, s, side="right") - 1, np.searchsorted(at, s + len(place))
                ends = np.minimum(np.repeat(at[low + 1 : high + 1], np.diff(np.clip(at[low : high + 1], s, s + len(place)))) - s, len(part))
                fits = np.arange(len(place)) + least <= ends
                turn = (place[1:] != place[:-1]) | ~fits[1:] | ~fits[:-1]
                # a text ends between windows that fit only where its last ones don't
                first = np.flatnonzero(fits & np.concatenate([[True], turn]))
                last = np.flatnonzero(fits & np.concatenate([turn, [True]]))
                if not len(first):
                    continue
                doc = np.searchsorted(at, first + s, side="right") - 1
                content = _digests(part, first, last + least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[place[first]].view(np.int64)), pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(ids[doc]), pa.array(prints[doc]), pa.array((first + s - at[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((place[first] - first).astype(np.int32))],
                    names=["minimiser", "content_a", "content_b", "id", "print", "start", "windows", "offset"],
                )

    return run


CONTENT = ["content_a", "content_b"]
BANDS = "core_a long, core_b long, id long, print long, start int, many boolean, head binary, tail binary"


def _bands(least: int, code=iter):
    """Cut the segments of each text (data, spots of start, windows, offset, many) into bands.

    A window of offset o (from its start to its minimiser) is in band o // BAND; what all
    windows of a band hold is the core, from the nearest start to the earliest end.
    """
    core = least - BAND + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in code(batches):
            if not batch.num_rows:
                continue
            spots = batch.column("spots")
            each = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
            start, windows, offset, many = (spots.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows", "offset", "many"))
            start = start.astype(np.int64)
            high, low = offset.astype(np.int64), offset.astype(np.int64) - windows + 1
            bands = high // BAND - low // BAND + 1
            of = np.repeat(np.arange(len(start)), bands)
            band = np.arange(len(of)) - np.repeat(np.cumsum(bands) - bands, bands) + (low // BAND)[of]
            most, few = np.minimum(high[of], band * BAND + BAND - 1), np.maximum(low[of], band * BAND)
            spot = start[of] + high[of]  # of the minimiser
            a, b = spot - most, spot - band * BAND  # the head, and the core's start
            c, d = b + core, spot - few + least  # the tail
            ids, prints = batch.column("id").to_numpy(), batch.column("print").to_numpy()
            texts = [x.as_buffer() for x in batch.column("data")]
            rows = each[of]
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            for i, text in enumerate(texts):
                x, y = cuts[i], cuts[i + 1]
                if x == y:
                    continue
                raw = text.to_pybytes()
                keys = _digests(np.frombuffer(raw, np.uint8), b[x:y], c[x:y]) ^ mix(band[x:y].astype(np.uint64) + np.uint64(1)).view(np.int64)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.full(y - x, ids[i])), pa.array(np.full(y - x, prints[i])), pa.array(a[x:y].astype(np.int32)), pa.array(many[of[x:y]]),
                     pa.array([raw[p:q] for p, q in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)], pa.binary()), pa.array([raw[p:q] for p, q in zip(c[x:y].tolist(), d[x:y].tolist(), strict=True)], pa.binary())],
                    names=["core_a", "core_b", "id", "print", "start", "many", "head", "tail"],
                )

    return run


_HELD: list[Rolling] = []


def _rolling(size: int) -> Rolling:
    """A hash for arrays of at least this size, kept for the next call."""
    if not _HELD or len(_HELD[0].up) <= size:
        _HELD[:] = [Rolling(1 << max(17, size.bit_length()))]
    return _HELD[0]


RANGES = "id long, print long, start int, windows int"


class Sorter:
    """Collects groups of strings around one core, sorts them together and tells the windows that repeat."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.head, self.tail, self.group, self.count, self.rows, self.groups = [], [], [], [], [], 0

    def add(self, group: pa.Table) -> None:
        known: dict[tuple, int] = {}
        for row in zip(*(group.column(c).to_pylist() for c in ("head", "tail", "id", "print", "start", "many")), strict=True):
            at = known.get(row[:2])
            if at is None:
                at = known[row[:2]] = len(self.head)
                self.head.append(row[0])
                self.tail.append(row[1])
                self.group.append(self.groups)
                self.count.append(0)
            self.count[at] += 2 if row[5] else 1
            if not row[5]:  # of a segment that occurs more than once every window is known already
                self.rows.append((at, *row[2:5]))
        self.groups += 1

    def full(self) -> bool:
        return len(self.head) >= CHUNK or self.groups >= 60_000

    def ranges(self) -> pa.RecordBatch:
        n = len(self.head)
        heads, tails = (np.fromiter(map(len, x), np.int64, n) for x in (self.head, self.tail))
        flat = np.frombuffer(b"".join(x for h, t in zip(self.head, self.tail, strict=True) for x in (h, b"\0", t)), np.uint8).astype(np.uint16) + np.uint16(1)
        lengths = heads + tails + 1
        begin = np.cumsum(lengths) - lengths
        flat[begin + heads] = CORE
        texts = np.zeros((n, 2 * self.width - 1), np.uint16)
        row = np.repeat(np.arange(n), lengths)
        texts[row, np.arange(len(flat)) - begin[row]] = flat
        marks = repeated(texts, lengths, np.array(self.group), self.width)
        marks |= (np.array(self.count) > 1)[:, None]
        marks &= np.arange(texts.shape[1]) <= np.minimum(heads, lengths - self.width)[:, None]
        at = np.array([r[0] for r in self.rows], np.int64)
        edge = np.diff(np.pad(marks[at].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        which, first = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        pick = lambda i: np.array([r[i] for r in self.rows], np.int64)[which]
        out = pa.RecordBatch.from_arrays([pa.array(pick(1)), pa.array(pick(2)), pa.array((pick(3) + first).astype(np.int32)), pa.array((end - first).astype(np.int32))], names=["id", "print", "start", "windows"])
        self.clear()
        return out


def _sort(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sorter(width)
        for group in grouped(batches, ["core_a", "core_b"]):
            if group.num_rows > 1:
                held.add(group)
                if held.full():
                    yield held.ranges()
        if held.rows:
            yield held.ranges()

    return run


def _halve(width: int):
    """Bands of a width to bands of half of it: windows with more than half of their surroundings before the core, and the others.

    A core grows by the half that all windows of the new band hold, so a crowd with one core parts by what surrounds it.
    """
    half = width // 2
    mask = 2**64 - 1

    def key(core: int, side: int, text: bytes) -> int:
        salt = (core & mask).to_bytes(8, "little") + bytes([side])
        return int.from_bytes(hashlib.blake2b(salt + text, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, i, p, start, many, head, tail in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if len(head) >= half:
                    near = head[len(head) - half :]
                    out.append((key(a, 0, near), key(b, 1, near), i, p, start, many, head[: len(head) - half], tail[: half - 1]))
                if len(tail) >= half:
                    near, less = tail[:half], head[max(0, len(head) - half + 1) :]
                    out.append((key(a, 2, near), key(b, 3, near), i, p, start + len(head) - len(less), many, less, tail[half:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), batch.schema.types, strict=True)], names=batch.schema.names)

    return run


KEYS = ["core_a", "core_b"]


def _settle(bands: DataFrame, width: int = BAND) -> DataFrame:
    return bands.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_sort(width), RANGES)


def _part(crowd: DataFrame) -> DataFrame:
    """Settle bands of crowded minimisers: cores with too many rows are halved until each window stands alone, when counting settles it."""
    width, done = BAND, []
    core = (F.col("core_a") == F.col("a")) & (F.col("core_b") == F.col("b"))
    while width > 1:
        large = few(crowd.groupBy(*KEYS).count().where(F.col("count") > CROWD).select(apart(F.col("core_a")).alias("a"), apart(F.col("core_b")).alias("b")))
        done.append(_settle(crowd.join(large, core, "left_anti"), width))
        crowd = cut(crowd.join(large, core, "left_semi").mapInArrow(_halve(width), BANDS))
        width //= 2
        if crowd.isEmpty():
            break
    else:
        counts = crowd.groupBy(*KEYS).agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where(F.col("n") > 1)
        counts = few(counts.select(apart(F.col("core_a")).alias("a"), apart(F.col("core_b")).alias("b")))
        done.append(crowd.where(~F.col("many")).join(counts, core).select("id", "print", "start", F.lit(1).alias("windows")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _with(rows: DataFrame, by_text: DataFrame, how: str) -> DataFrame:
    """rows with what is known of their texts; both sides are shuffled for the join, so a text that many rows repeat can be split."""
    known = by_text.withColumn("__key", apart(F.col("id"))).withColumnRenamed("print", "__print").drop("id")
    return rows.join(known, (rows["id"] == known["__key"]) & (rows["print"] == known["__print"]), how).drop("__key", "__print")


def repeated_windows(rows: DataFrame, least: int = LEAST, gram: int = GRAM, code=iter, shortest: int | None = None) -> DataFrame:
    """Of rows (id, print, data; id and print never null) the runs of windows (id, print, start, windows) that start at other places too.

    id and print together name a text; rows that repeat them are texts of their own, which makes all their windows repeats.
    code: what turns batches into those with the data to compare, in the same worker; shortest: bytes of data, before that, that have a window.
    """
    ship(rows.sparkSession)
    found = rows.where(F.octet_length("data") >= (shortest or least)).mapInArrow(_segments(least, gram, code), SEGMENTS)
    least_and_most = [f(c).alias(f"{name}_{c}") for c in CONTENT for name, f in (("low", F.min), ("high", F.max))]
    counts = found.groupBy("minimiser").agg(F.count("*").alias("n"), *least_and_most)
    differ = F.greatest(*(F.col(f"low_{c}") != F.col(f"high_{c}") for c in CONTENT))
    counts = counts.where(F.col("n") > 1).select(apart(F.col("minimiser")).alias("key"), differ.alias("differ"))
    shared = cut(found.join(counts, F.col("minimiser") == F.col("key")).drop("key"))
    plain = shared.where(~F.col("differ")).select("id", "print", "start", "windows")
    mixed = shared.where("differ")
    spot = F.struct("id", "print", "start", "windows", "offset")
    kinds = cut(mixed.groupBy("minimiser", *CONTENT).agg(F.count("*").alias("n"), F.min(spot).alias("spot")))
    many = few(kinds.where(F.col("n") > 1).select("minimiser", *CONTENT))
    whole = mixed.join(many, ["minimiser", *CONTENT]).select("id", "print", "start", "windows")

    def bands(chosen: DataFrame) -> DataFrame:
        asked = chosen.select("spot.*", (F.col("n") > 1).alias("many")).groupBy("id", "print").agg(F.collect_list(F.struct("start", "windows", "offset", "many")).alias("spots"))
        return _with(rows, asked, "inner").select("id", "print", "data", "spots").mapInArrow(_bands(least, code), BANDS)

    out = plain.unionByName(whole)
    crowded = kinds.groupBy("minimiser").count().where(F.col("count") > CROWD).select(apart(F.col("minimiser")).alias("key"))
    if crowded.isEmpty():
        return out.unionByName(_settle(bands(kinds)))
    crowded = cut(crowded)
    same = F.col("minimiser") == F.col("key")
    calm = _settle(bands(kinds.join(crowded, same, "left_anti")))
    return out.unionByName(calm).unionByName(_part(cut(bands(kinds.join(crowded, same, "left_semi")))))


def _remove(spans_of):
    """spans_of(data, found): the runs of bytes [start, end] to remove, in their order and apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            kept, texts, spans = [], [], []
            for data, found in zip(batch.column("data").to_pylist(), batch.column("__found").to_pylist(), strict=True):
                runs = spans_of(data, found) if found else []
                edges = [0, *(e for r in runs for e in r), len(data)]
                pieces = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept.append(b"".join(pieces))
                texts.append("".join(p.decode("utf-8", "ignore") for p in pieces))
                spans.append([{"start": a, "end": b} for a, b in runs])
            batch = batch.drop_columns(["data", "__found"]).append_column("__kept", pa.array(kept, pa.binary()))
            yield batch.append_column("__text", pa.array(texts, pa.string())).append_column("__spans", pa.array(spans, kind))

    return run


def _joined(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs [start, end] in their order; those that meet are one."""
    out: list[list[int]] = []
    for x in sorted(runs):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return out


def _byte_spans(least: int):
    return lambda data, found: _joined([(f["start"], f["start"] + f["windows"] - 1 + least) for f in found])


def _word_spans(words: int):
    def spans(data: bytes, found: list[dict]) -> list[list[int]]:
        # of the windows over codes only those count that begin with a whole code
        whole = [(-(-f["start"] // CODE), (f["start"] + f["windows"] - 1) // CODE) for f in found]
        begin, end = word_edges(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return [[int(begin[a]), int(end[b - 1])] for a, b in _joined([(a, b + words) for a, b in whole if a <= b])]

    return spans


def word_edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end; data: the bytes of all texts, at: where each begins, and the end.

    A word is a run of bytes without blanks (ASCII white space); in scripts written without
    blanks (U+3000 to U+9FFF) each character is one.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    single = (data >= 0xE3) & (data <= 0xE9)  # first bytes, of three each
    turn = edge[:n] | single
    turn[1:] |= ~solid[:-1]
    turn[3:] |= single[:-3]
    begins = solid & turn
    ends = edge[1:].copy()
    ends[:-1] |= begins[1:] | ~solid[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends & solid) + 1


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a code of CODE bytes, from a hash, for each word, and nothing between them."""
    for batch in batches:
        # a hash holds powers for every byte, so few bytes are hashed at a time
        for part in slices(batch, "data"):
            data, at = _bytes(part.column("data"))
            begin, end = word_edges(data, at)
            h = _rolling(len(data))
            codes = h.of(h.sums(data), begin, end).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
            cuts = (np.searchsorted(begin, at) * CODE).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(codes.tobytes())])
            yield part.set_column(part.schema.get_field_index("data"), "data", made)


def text_id(doc_id: Column) -> Column:
    """doc_id, or a reserved value for null."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


@shielded
def remove_repeats(rows: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """rows (id, print, data and any other columns) with __kept, __text and __spans in place of data.

    __kept: the bytes without those covered by a window that also starts elsewhere; __spans: the maximal
    removed runs of bytes; __text: what is left as text, without characters that lost a byte. Texts shorter than a window, and empty ones, stay as they are.
    Names that begin with two underscores are as common.shielded says.
    """
    return _without(rows, repeated_windows(rows.select("id", "print", "data"), least, gram), _byte_spans(least))


@shielded
def remove_passages(rows: DataFrame, words: int) -> DataFrame:
    """As remove_repeats, for the passages of `words` words in a row that also start elsewhere, whatever the blanks between the words.

    Texts are compared as codes of their words, so a window is of so many words and not of bytes; a passage of fewer words stays,
    however long. Two words share a code of 48 bits by chance only, and a window needs all of its codes to be equal.
    """
    # the shortest passage has words and blanks of a byte each
    found = repeated_windows(rows.select("id", "print", "data"), words * CODE, PASSAGE_GRAM, _codes, 2 * words - 1)
    return _without(rows, found, _word_spans(words))


def _without(rows: DataFrame, found: DataFrame, spans_of) -> DataFrame:
    found = found.groupBy("id", "print").agg(F.collect_list(F.struct("start", "windows")).alias("__found"))
    met = _with(rows, found, "left")
    return met.mapInArrow(_remove(spans_of), extended(met, "__kept binary, __text string, __spans array<struct<start:int,end:int>>", ("data", "__found")))


def as_bytes(documents: DataFrame) -> DataFrame:
    """(id, print, data) of documents (doc_id, text): a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(text_id(F.col("doc_id")).alias("id"), F.xxhash64(text).alias("print"), text.cast("binary").alias("data"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 400 that also start elsewhere; text: the whole characters of it."""
    out = remove_repeats(as_bytes(table(spark, sf_dir, "documents")))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        (F.octet_length("__kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
        F.col("__text").alias("text"),
    )


ORACLE_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM h WHERE length(x) >= 800)),
b AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS turn FROM w SEMI JOIN b USING (k)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(turn) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM r),
k AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone, string_agg(substring(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || any_value(substring(x, 2 * z + 1)) FILTER (back = 1) AS kept,
  string_agg(regexp_replace(regexp_replace(substring(x, 2 * was + 1, 2 * (a - was)), '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' ORDER BY a)
    || any_value(regexp_replace(substring(x, 2 * z + 1), '^([89AB].)+', '')) FILTER (back = 1) AS seen FROM e JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256, decode(unhex(coalesce(seen, x))) AS text FROM h LEFT JOIN k USING (doc_id)"""
