"""Measures of pictures from their bytes: width and height from the header, and how sharp they look. No decoding.

PNG and WebP have their measures at fixed places and are read by column expressions; a JPEG's segments have to be followed,
and sharpness is a sum over bytes, so these two see Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that sharpness looks at.
LOOKED_AT = 30_000
_FRAMES, _BARE = (0xC0, 0xC1, 0xC2), (0xD8, 0x01)


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files under a folder, by Spark's reader of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def _number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """The unsigned number in ``size`` bytes from ``at``."""
    digits = [F.hex(F.substring(data, at + k + 1, 1)) for k in range(size)]
    return F.conv(F.concat(*(reversed(digits) if little else digits)), 16, 10).cast("long")


def _starts(data: Column, at: int, text: bytes) -> Column:
    return F.hex(F.substring(data, at + 1, len(text))) == text.hex().upper()


def _jpeg(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of the first frame; null where the segments lead to none."""
    at, end = 2, len(data)
    while at < end - 1:
        kind = data[at + 1]
        if data[at] != 0xFF:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                return None
        elif kind in _FRAMES:
            frame = data[at + 5 : at + 9]
            return (frame[2] << 8 | frame[3], frame[0] << 8 | frame[1]) if len(frame) == 4 else None
        elif kind in _BARE:
            at += 2
        elif at + 4 <= end:
            at += 2 + (data[at + 2] << 8 | data[at + 3])
        else:
            at += 1
    return None


def _jpegs(content: pd.Series) -> pd.DataFrame:
    found = [_jpeg(x) if x is not None else None for x in content]
    return pd.DataFrame([x or (None, None) for x in found], columns=["width", "height"], dtype="Int64")


def _sharp(content: pd.Series) -> pd.Series:
    def of(data: bytes | None) -> float:
        if data is None or len(data) < 4:
            return 0.0
        return float(np.abs(np.diff(np.frombuffer(data[:LOOKED_AT], np.uint8).astype(np.int16))).std())

    return content.map(of, na_action=None).astype("float64")


def measured(pictures: DataFrame, content: str = "content") -> DataFrame:
    """Adds `size` (width and height; null for other formats, cut files and fewer than 24 bytes) and `sharpness` (how much
    neighbouring bytes differ, as the deviation of their distances; 0 for fewer than four bytes)."""
    data = F.col(content)
    n = F.length(data)
    pair = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    is_jpeg = (n >= 24) & _starts(data, 0, b"\xff\xd8")
    jpeg = F.pandas_udf(_jpegs, "width long, height long")(F.when(is_jpeg, data))
    pictures = pictures.withColumn("_jpeg_size", jpeg)
    webp = (n >= 30) & _starts(data, 0, b"RIFF") & _starts(data, 8, b"WEBP")
    bits = _number(data, 21, 4, True)
    low = lambda c, k: c.bitwiseAND(F.lit((1 << k) - 1))
    size = (
        F.when(n < 24, None).when(is_jpeg, F.when(F.col("_jpeg_size.width").isNotNull(), F.col("_jpeg_size")))
        .when(_starts(data, 0, b"\x89PNG\r\n\x1a\n"), pair(_number(data, 16, 4), _number(data, 20, 4)))
        .when(webp & _starts(data, 12, b"VP8 "), pair(low(_number(data, 26, 2, True), 14), low(_number(data, 28, 2, True), 14)))
        .when(webp & _starts(data, 12, b"VP8L"), pair(low(bits, 14) + 1, low(F.shiftright(bits, 14), 14) + 1))
        .when(webp & _starts(data, 12, b"VP8X") & (n >= 32), pair(_number(data, 24, 3, True) + 1, _number(data, 28, 3, True) + 1))
    )
    return pictures.withColumns({"size": size, "sharpness": F.pandas_udf(_sharp, "double")(data)}).drop("_jpeg_size")
