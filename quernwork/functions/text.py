"""Text functions as native Spark expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

#: Code point ranges whose single-character compatibility decompositions fold() applies.
_RANGES = ((0xA0, 0x24F), (0x370, 0x4FF), (0x1E00, 0x1FFF), (0x2070, 0x209C), (0xFF01, 0xFF5E))


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose lower-cased decomposition has one base character, and those base characters."""
    src, dst = [], []
    for lo, hi in _RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c))
            if len(base) == 1 and base != ch and base != " ":
                src.append(ch)
                dst.append(base.lower())
    return "".join(src), "".join(dst)


def fold(c: Column | str) -> Column:
    """Lower case without accents, marks and invisible characters. Null stays null."""
    src, dst = fold_table()
    x = F.lower(F.translate(F.col(c) if isinstance(c, str) else c, src, dst))
    return F.regexp_replace(x, r"[\p{M}\p{Cf}]+", "")


@cache
def _dropped() -> re.Pattern:
    """Combining marks and format characters of the basic plane, and the tag characters."""
    hit = [cp for cp in range(0x80, 0x10000) if unicodedata.combining(chr(cp)) or unicodedata.category(chr(cp)) == "Cf"]
    ranges, start = [], hit[0]
    for x, y in zip(hit, [*hit[1:], None], strict=True):
        if y != x + 1:
            ranges.append(f"{chr(start)}-{chr(x)}")
            start = y
    return re.compile("[" + "".join(ranges) + "\U000e0001-\U000e007f]+")


def fold_py(s: str | None) -> str:
    """fold() for use inside pandas UDFs, with full NFKD."""
    if not s:
        return ""
    if s.isascii():
        return s.lower()
    return _dropped().sub("", unicodedata.normalize("NFKD", s)).lower()


def words_only(c: Column) -> Column:
    """Runs of anything but letters and digits as one space, none at the ends; for folded text."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty or white-space-only text (no-break spaces included)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.regexp_replace(c, r"[\s ​﻿]+", "") != "", c)


def source_key(c: Column | str) -> Column:
    """A source name without case, blanks and separators; null stays null."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[^a-z0-9]+", "")
