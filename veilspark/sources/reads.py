"""Reads of screens: JSON of lines and words with boxes, and images as rows of pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_BOX = T.ArrayType(T.DoubleType())
_WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("box", _BOX)])
_LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("box", _BOX), T.StructField("words", T.ArrayType(_WORD))])
READ = T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("lines", T.ArrayType(_LINE))])


def reads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row for each JSON read, with its file."""
    return spark.read.schema(READ).option("multiLine", multi_line).json(path).selectExpr("*", "_metadata.file_path as path")


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3 or 4) of an 8-bit RGB or RGBA image that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only 8-bit RGB and RGBA, not interlaced")
    width, height, n = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, int)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:].astype(int)
        if how == 1:
            line = np.cumsum(line.reshape(width, n), axis=0).ravel() % 256
        elif how == 2:
            line = (line + above) % 256
        elif how in (3, 4):
            for i in range(len(line)):
                a, b, c = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
                p = (a + b) // 2 if how == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[i] = (line[i] + p) % 256
        out[y] = above = line
    return out.reshape(height, width, n)
