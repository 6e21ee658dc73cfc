"""Strict decoding of source bytes to text, and the text transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Charsets that are decoded, by how.
UTF8 = ("utf8", "utf8mb3", "utf8mb4", "binary")
WESTERN = ("latin1", "windows-1252")
SUPPORTED = (*UTF8, *WESTERN, "ascii", "iso-8859-1")


def _western() -> tuple[str, str]:
    """The C1 controls, and what windows-1252 has in their places; its five gaps stay controls."""
    codes = range(0x80, 0xA0)
    return "".join(map(chr, codes)), "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in codes)


def decode(raw: Column, charset: str | None) -> tuple[Column, Column]:
    """(text, problem) of binary values; problem is null where the bytes are valid in the charset."""
    name = charset or "utf8mb4"
    raw = raw.cast("binary")
    if name in WESTERN or name == "iso-8859-1":
        text = F.decode(raw, "ISO-8859-1")
        return (F.translate(text, *_western()) if name in WESTERN else text), F.lit(None).cast("string")
    as_text = raw.cast("string")
    if name == "ascii":
        bad = F.when(~as_text.rlike(r"\A[\x00-\x7F]*\z") | ~F.is_valid_utf8(as_text), F.lit("charset"))
    elif name in UTF8:
        bad = F.when(~F.is_valid_utf8(as_text), F.lit("charset"))
        if name == "utf8mb3":
            bad = F.coalesce(bad, F.when(as_text.rlike(r"[\x{10000}-\x{10FFFF}]"), F.lit("charset")))
    else:
        raise ValueError(f"no strict decoding for charset {name}")
    return F.when(bad.isNull(), as_text), bad


def right_trim(text: Column) -> Column:
    """Without trailing Unicode white space."""
    return F.regexp_replace(text, r"[\p{IsWhite_Space}]+\z", "")


def remove_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\0"))
