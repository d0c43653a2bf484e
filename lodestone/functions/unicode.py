"""Unicode normalization with offsets back to the raw text.

Spark has no normalization function, so this is the one text step that crosses
into Python. Text whose characters all lie below U+0300 is already NFC; it is
sent to the worker as NULL, so only text that may change pays for the transfer.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def check_form(form: str) -> str:
    if form not in FORMS:
        raise ValueError(f"unknown normalization form {form!r}")
    return form


def may_change(text: Column, form: str = "NFC") -> Column:
    """False only where normalization provably leaves ``text`` alone."""
    if form == "NFC":
        return text.rlike(r"[\x{300}-\x{10FFFF}]")
    return F.octet_length(text) != F.length(text)


def _continuation_class() -> str:
    """Regex class of characters that attach to the one before them: combining
    marks, Hangul vowels and finals, and class-0 marks that compose."""
    composing = {
        parts[1]
        for code in range(0x300, sys.maxunicode + 1)
        for parts in [unicodedata.decomposition(chr(code)).split()]
        if len(parts) == 2 and not parts[0].startswith("<")
    }
    codes = [
        code
        for code in range(0x300, sys.maxunicode + 1)
        if unicodedata.combining(chr(code))
        or 0x1160 <= code <= 0x11FF
        or (f"{code:04X}" in composing and unicodedata.category(chr(code)).startswith("M"))
    ]
    ranges, first = [], codes[0]
    for here, following in zip(codes, codes[1:] + [None]):
        if following != here + 1:
            ranges.append(f"\\U{first:08x}-\\U{here:08x}")
            first = following
    return "".join(ranges)


_SEQUENCE = re.compile(f"(?s:.)[{_continuation_class()}]+")


def _singles(raw: str, start: int, form: str, out: list, offsets: list) -> None:
    if unicodedata.is_normalized(form, raw):
        out.append(raw)
        offsets.append(np.arange(start, start + len(raw), dtype=np.int32))
        return
    pieces = [unicodedata.normalize(form, ch) for ch in raw]
    out.extend(pieces)
    places = np.arange(start, start + len(raw), dtype=np.int32)
    offsets.append(np.repeat(places, [len(piece) for piece in pieces]))


def normalize_with_offsets(raw: str, form: str = "NFC") -> tuple[str, np.ndarray]:
    """Normalized text and, for each of its characters plus one past the end,
    the raw offset where the combining sequence it came from starts."""
    check_form(form)
    out: list[str] = []
    offsets: list[np.ndarray] = []
    done = 0
    for match in _SEQUENCE.finditer(raw):
        if match.start() > done:
            _singles(raw[done : match.start()], done, form, out, offsets)
        piece = unicodedata.normalize(form, match.group())
        out.append(piece)
        offsets.append(np.full(len(piece), match.start(), dtype=np.int32))
        done = match.end()
    if done < len(raw):
        _singles(raw[done:], done, form, out, offsets)
    offsets.append(np.array([len(raw)], dtype=np.int32))
    return "".join(out), np.concatenate(offsets)


def normalized(text: Column, form: str = "NFC") -> Column:
    """Normalized text."""
    check_form(form)

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return F.coalesce(apply(F.when(may_change(text, form), text)), text)


def normalized_with_map(text: Column, form: str = "NFC") -> Column:
    """``struct(norm, map)``; NULL where the text cannot change (identity map)."""
    check_form(form)

    @F.pandas_udf("norm string, map array<int>")
    def apply(values: pd.Series) -> pd.DataFrame:
        pairs = [
            (None, None)
            if value is None or unicodedata.is_normalized(form, value)
            else normalize_with_offsets(value, form)
            for value in values
        ]
        return pd.DataFrame(pairs, columns=["norm", "map"])

    return apply(F.when(may_change(text, form), text))


def offset_drift(text: Column, form: str = "NFC") -> Column:
    """Characters that normalization adds (positive) or removes (negative)."""
    return F.length(normalized(text, form)) - F.length(text)
