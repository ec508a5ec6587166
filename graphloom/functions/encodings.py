"""What bytes are encoded in, and their text, as column expressions.

A byte order mark decides; without one, bytes below 128 without zeros are ASCII, valid UTF-8 is
UTF-8, bytes in pairs with zeros on one side mainly are UTF-16, and what is left is
Windows-1252 if it holds a byte from 128 to 159 that stands for a character there, else
ISO-8859-1. Confidence is 1 for a mark, for ASCII and for UTF-8, the share of zeros on the
greater side for UTF-16, and the share of letters among the bytes above 127 for the others.

Defined cases: null bytes give nulls; no bytes are UTF-8 at confidence 0; a mark alone is an
empty text; bytes that an encoding has no character for become U+FFFD."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte order marks. That of UTF-32 begins as one of UTF-16, so it comes first.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Bytes that Windows-1252 has no character for.
_NONE = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_ZEROS = 0.2  # of all places of one side that are zeros in UTF-16, at least


def guessed(data: bytes) -> tuple[str, float]:
    if not data:
        return "utf-8", 0.0
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, 1.0
    a = np.frombuffer(data, np.uint8)
    if data.isascii() and b"\0" not in data:
        return "ascii", 1.0
    if len(a) % 2 == 0:
        high, low = float(np.mean(a[0::2] == 0)), float(np.mean(a[1::2] == 0))
        if max(high, low) >= _ZEROS and max(high, low) > 4 * min(high, low):
            return ("utf-16-be", high) if high > low else ("utf-16-le", low)
    try:
        data.decode()
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    upper = a[a > 127]
    letters = float(np.mean((upper >= 0xC0) & (upper != 0xD7) & (upper != 0xF7)))
    windows = (upper < 0xA0) & ~np.isin(upper, _NONE)
    return ("windows-1252" if windows.any() else "iso-8859-1"), letters


def decoded(data: bytes, encoding: str) -> str:
    for mark, name in MARKS:
        if name == encoding and data.startswith(mark):
            data = data[len(mark) :]
            break
    return data.decode(encoding, errors="replace")


def detected(data: Column) -> Column:
    """struct<encoding, confidence> of whole binary values, by Arrow batches."""

    @F.pandas_udf("struct<encoding:string,confidence:double>")
    def batch(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if d is None else guessed(d) for d in values], columns=["encoding", "confidence"])

    return batch(data)


def as_text(data: Column, encoding: Column | None = None) -> Column:
    """The text of binary values, without a mark; the encoding is found out where it is null."""

    @F.pandas_udf("string")
    def batch(values: pd.Series, encodings: pd.Series) -> pd.Series:
        def one(d: bytes | None, e: str | None) -> str | None:
            return None if d is None else decoded(d, e or guessed(d)[0])

        return pd.Series([one(d, e) for d, e in zip(values, encodings, strict=True)], dtype=object)

    return batch(data, F.lit(None).cast("string") if encoding is None else encoding)


def without_mark(data: Column) -> Column:
    """Without a byte order mark of UTF-8 or UTF-16; in the JVM."""
    start = F.hex(F.substr(data, F.lit(1), F.lit(3)))
    return F.when(start == "EFBBBF", F.substr(data, F.lit(4))).when(F.left(start, F.lit(4)).isin("FFFE", "FEFF"), F.substr(data, F.lit(3))).otherwise(data)


def is_valid(data: Column, encoding: str) -> Column:
    """Whether bytes can be read in an encoding; UTF-8 in the JVM, others by Arrow batches."""
    if encoding == "utf-8":
        return F.is_valid_utf8(data.cast("string"))

    @F.pandas_udf("boolean")
    def readable(values: pd.Series) -> pd.Series:
        def one(d: bytes) -> bool:
            try:
                d.decode(encoding)
                return True
            except UnicodeDecodeError:
                return False

        return values.map(one, na_action="ignore")

    return readable(data)
