"""Operators on images, by an image provider that runs in pandas UDFs on the executors.

An image is bytes, a struct of bytes and path, or a path or URL. The offline provider knows a file's format and size and
nothing of its content; models implement the same methods.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What detection gives for each object; area is its share of the image.
BOXES = "array<struct<label: string, confidence: double, x: double, y: double, w: double, h: double, area: double>>"


class ImageProvider(Protocol):
    def holds(self, images: Sequence[bytes | None], condition: str) -> list[bool | None]: ...

    def label(self, images: Sequence[bytes | None], labels: Sequence[str]) -> list[str | None]: ...

    def detect(self, images: Sequence[bytes | None]) -> list[list[dict] | None]: ...

    def embed(self, images: Sequence[bytes | None]) -> list[list[float] | None]: ...


def kind(data: bytes) -> tuple[str | None, int, int]:
    """(format, width, height) by a file's first bytes; 0 where the size isn't told there."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        return ("bmp", *map(abs, struct.unpack("<ii", data[18:26])))
    return ("jpeg", 0, 0) if data[:3] == b"\xff\xd8\xff" else (None, 0, 0)


class OfflineImages:
    """Answers by format and size alone."""

    def holds(self, images, condition):
        return [None if b is None else (kind(b)[0] or "") in condition.lower().split() for b in images]

    def label(self, images, labels):
        return [None if b is None else next((x for x in labels if x.lower() == kind(b)[0]), None) for b in images]

    def detect(self, images):
        return [None if b is None else [] for b in images]

    def embed(self, images):
        return [None if b is None or kind(b)[0] is None else [float(x) for x in kind(b)[1:]] for b in images]


def image_bytes(c: Column, dtype: str) -> Column:
    """The bytes of an image column of any kind; paths and URLs are null here and are read with ``sources.images``."""
    return c if dtype == "binary" else c["bytes"] if dtype.startswith("struct") else F.lit(None).cast("binary")


def _each(df: DataFrame, column: str, schema: str, ask) -> Column:
    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(ask([None if x is None else bytes(x) or None for x in s]), dtype=object)

    return run(image_bytes(F.col(column), dict(df.dtypes)[column]))


def image_filter(df: DataFrame, column: str, condition: str, provider: ImageProvider | None = None) -> DataFrame:
    """Rows whose image satisfies a condition; no image, no row."""
    p = provider or OfflineImages()
    return df.filter(F.coalesce(_each(df, column, "boolean", lambda x: p.holds(x, condition)), F.lit(False)))


def image_labels(df: DataFrame, column: str, labels: Sequence[str], name: str = "category", provider: ImageProvider | None = None) -> DataFrame:
    p = provider or OfflineImages()
    return df.withColumn(name, _each(df, column, "string", lambda x: p.label(x, labels)))


def image_objects(df: DataFrame, column: str, name: str = "objects", provider: ImageProvider | None = None) -> DataFrame:
    p = provider or OfflineImages()
    return df.withColumn(name, _each(df, column, BOXES, p.detect))


def image_vectors(df: DataFrame, column: str, name: str = "embedding", provider: ImageProvider | None = None) -> DataFrame:
    p = provider or OfflineImages()
    return df.withColumn(name, _each(df, column, "array<float>", p.embed))


def available(modules: Sequence[str] = ("PIL", "torch", "transformers", "spacy", "ultralytics", "keybert")) -> dict[str, bool]:
    """Which optional tools can be imported."""
    import importlib.util

    return {m: importlib.util.find_spec(m) is not None for m in modules}
