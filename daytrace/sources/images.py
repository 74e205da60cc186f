"""Image files: uncompressed pixel maps (P3 as text, P6 as bytes) read as binary files and analysed in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.session import ship

#: Cells on a side of the hash and of the thumbnail.
HASH_SIZE, THUMBNAIL_SIZE = 8, 32
# format of the files: kind, width, height and largest value, with comments, then the samples
_HEADER = re.compile(rb"P([36])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
ANALYSIS = "width INT, height INT, exact_hash STRING, perceptual_hash STRING, thumbnail ARRAY<INT>"


def decode(content: bytes) -> np.ndarray | None:
    """(height, width, 3) bytes of a pixel map; null if it is none, has no pixels or fewer samples than it says."""
    head = _HEADER.match(content or b"")
    if head is None:
        return None
    width, height, most = (int(head[i]) for i in (2, 3, 4))
    n = width * height * 3
    if not n or most != 255:
        return None
    body = content[head.end() :]
    if head[1] == b"6":
        return np.frombuffer(body, dtype=np.uint8, count=n).reshape(height, width, 3) if len(body) >= n else None
    samples = body.split()
    if len(samples) < n or any(not s.isdigit() or int(s) > 255 for s in samples[:n]):
        return None
    return np.array(samples[:n], dtype=np.uint8).reshape(height, width, 3)


def gray_cells(pixels: np.ndarray, size: int) -> np.ndarray:
    """M5: gray values at the centres of a grid's cells, row by row."""
    at = lambda n: np.minimum(n - 1, ((np.arange(size) + 0.5) * n / size).astype(int))
    cells = pixels[at(pixels.shape[0])][:, at(pixels.shape[1])].reshape(-1, 3).astype(np.int64)
    return cells @ np.array([299, 587, 114]) // 1000


def average_hash(gray: np.ndarray) -> str:
    """M3: a bit per cell, set where it is at least the mean, as hex digits."""
    bits = "".join("1" if v * len(gray) >= gray.sum() else "0" for v in gray)
    return f"{int(bits, 2):0{-(-len(gray) // 4)}x}"


def analyse(pictures: DataFrame, name: str = "path") -> DataFrame:
    """M3, M5: (name, width, height, exact_hash, perceptual_hash, thumbnail) of pictures (name, content), in one pass.

    The exact hash is a SHA-256 of the pixels and the size. What is no pixel map has its name and nulls.
    """
    ship(pictures.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for of, content in zip(batch[name], batch.content, strict=True):
                pixels = decode(content)
                if pixels is None:
                    out.append((of, None, None, None, None, None))
                    continue
                height, width, _ = pixels.shape
                exact = hashlib.sha256(pixels.tobytes() + f"{width}x{height}".encode()).hexdigest()
                out.append((of, width, height, exact, average_hash(gray_cells(pixels, HASH_SIZE)), gray_cells(pixels, THUMBNAIL_SIZE).tolist()))
            table = pd.DataFrame(out, columns=[name, "width", "height", "exact_hash", "perceptual_hash", "thumbnail"])
            yield table.astype({"width": "Int32", "height": "Int32"})

    return pictures.select(name, "content").mapInPandas(each, f"{name} STRING, {ANALYSIS}")


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """M3, M5: the analysis of the image files below a folder by path. An empty file has no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return analyse(files)


def read_image_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """M3, M5: the analysis by name of small pixel maps as text, many to a file: a line is a name without spaces, a space and the map.

    A file per small picture would take more time to make, list and open than its pixels. A line without a map has its
    name and nulls.
    """
    part = F.split("value", " ", 2)
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return analyse(lines.select(part[0].alias("name"), F.get(part, F.lit(1)).cast("binary").alias("content")), "name")
