"""SentencePiece models on the tokenizers library.

The model protobuf is read field by field; normaliser, metaspace marker, scores or merges and
byte fallback are rebuilt from it. Batches are encoded and decoded by the library's own threads.
Before any text is encoded, the rebuilt tokenizer is held against the sentencepiece library on
probe texts; and the operator can compare every row (check_rows), which about doubles its time.
"""

from __future__ import annotations

import os
import random
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import extended, shielded, ship, slices, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def byte_fallback(self) -> bool:
        return any(p[2] == BYTE for p in self.pieces)


def read_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            spec.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif number == 2:
            spec.kind = dict(wire(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(wire(value))
            spec.charsmap = rules.get(2, b"")
            spec.dummy_prefix, spec.squeeze, spec.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if spec.kind not in (UNIGRAM, BPE) or not spec.escape:
        raise ValueError("only unigram and BPE models that escape white space can be rebuilt")
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """All splits of ordinary pieces into two ordinary pieces, best piece first."""
    score = {p: s for p, s, k in spec.pieces if k in (NORMAL, USER)}
    ranked = sorted((-score[p], i, p) for i, (p, _, k) in enumerate(spec.pieces) if k in (NORMAL, USER) and len(p) > 1)
    return [(p[:i], p[i:]) for _, _, p in ranked for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


def build(spec: Spec):
    """The tokenizers-library tokenizer of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unknown, spec.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    made = Tokenizer(model)
    made.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    made.decoder = decoders.Sequence(tail + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    made.add_tokens([AddedToken(p, normalized=False) for p, _, k in spec.pieces if k == USER])
    return made


def probes(seed: int = 3) -> list[str]:
    """Fixed and drawn texts that try white space, controls, byte pieces, scripts and long words."""
    fixed = ["", " ", "  a  b ", "a\n\nb\t", "<s></s><unk>", "<0x0A>", "naïve ÀÉ ñ ß", "日本語テスト", "🙂👍🏽", "\u0000\u0001", "▁x ▁", "é", "x" * 300, "﻿q", "עברית العربية", "a b　c"]
    draw = random.Random(seed)
    pool = "abcdefghijklmnopqrstuvwxyz  \n.,ABCÉéß漢字кир🙂0123456789<>[]/"
    return fixed + ["".join(draw.choice(pool) for _ in range(draw.randint(1, 200))) for _ in range(300)]


class Decoder:
    """The bytes behind ids, for whole batches at once."""

    def __init__(self, spec: Spec):
        words = [bytes([int(p[1:-1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, _, k in spec.pieces]
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.prefix = spec.dummy_prefix

    def texts(self, flat: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of the runs of ids between the cuts; bytes that aren't UTF-8 become U+FFFD."""
        length = self.length[flat]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[flat] - ends + length, length)
        data, ends = self.pool[at].tobytes(), np.concatenate([[0], ends])[cuts]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
        return [t.removeprefix(" ") for t in out] if self.prefix else out


@lru_cache(maxsize=2)
def load(data: bytes):
    """The tokenizer of a model's bytes, its sentencepiece twin, a decoder, and on how many probes ids or decoded texts differ."""
    import sentencepiece

    spec, twin = read_model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    made, decoder, texts = build(spec), Decoder(spec), probes()
    ours, theirs = [e.ids for e in made.encode_batch(texts, add_special_tokens=False)], twin.encode(texts)
    back = decoder.texts(np.array([i for x in theirs for i in x]), np.cumsum([0] + [len(x) for x in theirs]))
    differ = sum(a != b or t != twin.decode(b) for a, b, t in zip(ours, theirs, back, strict=True))
    return made, twin, decoder, differ


KINDS = "__ids array<int>, __decoded string, __same boolean"


def _encode(shared, check_rows: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        made, twin, decoder, differ = load(shared.value)
        if differ:
            raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on {differ} probe texts")
        for batch in batches:
            for part in slices(batch, "text", 200_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                # an encoding holds far more than its ids, so only these outlive a slice
                ids = [np.asarray(e.ids, np.int32) for e in made.encode_batch_fast(texts, add_special_tokens=False)]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                column = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat, pa.int32()))
                back = decoder.texts(flat, cuts) if decode else [None] * len(ids)
                same = [a.tolist() == b for a, b in zip(ids, twin.encode(texts), strict=True)] if check_rows else [None] * len(ids)
                for name, values in (("__ids", column), ("__decoded", pa.array(back, pa.string())), ("__same", pa.array(same, pa.bool_()))):
                    part = part.append_column(name, values)
                yield part

    return run


@shielded
def tokenize(rows: DataFrame, model_path: str = MODEL_PATH, check_rows: bool = False, decode: bool = True) -> DataFrame:
    """rows (with text and any other columns) with __ids, __decoded and __same.

    A null text is encoded as an empty one, to no ids. __decoded: the text that the ids give back (null unless
    decode); it is the text itself but for what the model normalises and for the marker
    U+2581, which comes back as a blank. __same: whether sentencepiece gives the same ids (null
    unless check_rows). Fails if the rebuilt tokenizer and sentencepiece differ on the probes.
    Names that begin with two underscores are as common.shielded says.
    """
    spark = rows.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return rows.mapInArrow(_encode(shared, check_rows, decode), extended(rows, KINDS))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of ids, their digest, and whether the text came back."""
    out = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join("__ids", " ")
    return out.select("doc_id", F.size("__ids").alias("n_ids"), F.sha2(ids, 256).alias("ids_sha256"), (F.col("__decoded") == F.coalesce("text", F.lit(""))).alias("restored"))
