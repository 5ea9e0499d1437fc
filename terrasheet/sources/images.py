"""Images as pixel rows, and pixel rows as PNG files in a binary column."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The name up to the first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def read_images(spark: SparkSession, path: str, glob: str = "*.*") -> DataFrame:
    """(name, height, width, channels, data binary, origin): decoded files; data has the channels in the order B, G, R, A."""
    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob).load(path)
    i = F.col("image")
    return files.select(file_name(i["origin"]).alias("name"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"), i["origin"].alias("origin"))


def pixels(images: DataFrame, id_column: str = "name") -> DataFrame:
    """(map_id, y, x, r, g, b) of decoded images; grey images have three equal bands, alpha is dropped."""
    kind = images.schema[id_column].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h, w, n, data in zip(*(batch.column(c).to_pylist() for c in (id_column, "height", "width", "channels", "data")), strict=True):
                bands = np.frombuffer(data, np.uint8).reshape(h * w, n)
                order = (0, 0, 0) if n == 1 else (2, 1, 0)
                for k in range(0, h * w, 1 << 16):
                    at = np.arange(k, min(h * w, k + (1 << 16)))
                    columns = [pa.array([key] * len(at)), pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), *(pa.array(bands[at, c].astype(np.int32)) for c in order)]
                    yield pa.RecordBatch.from_arrays(columns, ["map_id", "y", "x", "r", "g", "b"])

    return images.select(id_column, "height", "width", "channels", "data").mapInArrow(expand, f"map_id {kind}, y int, x int, r int, g int, b int")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, left_data, right_data) of images of one name."""
    side = lambda df, s: df.select("name", *[F.col(c).alias(f"{s}_{c}") for c in ("height", "width", "channels", "data")])
    return side(left, "left").join(side(right, "right"), "name")


def masks(images: DataFrame) -> DataFrame:
    """(map_id, class, y, x) of the set pixels of files <map>-<class>.*."""
    named = pixels(images).where("r > 0").withColumn("class", F.get(F.split("map_id", "-"), F.lit(1))).withColumn("map_id", F.split("map_id", "-")[0])
    return named.where(F.col("class").isNotNull()).select("map_id", "class", "y", "x")


def png(bands: np.ndarray) -> bytes:
    """A PNG file of an array height x width (grey) or height x width x 3."""
    h, w = bands.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), bands.astype(np.uint8).reshape(h, -1)], 1)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if bands.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def as_png(df: DataFrame, by: list[str], value: str | list[str]) -> DataFrame:
    """(by, png binary): each group's pixels (y, x, value 0..255) as a grey file, or as a colour file of three values;
    missing pixels are 0.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    values = [value] if isinstance(value, str) else value

    def one(own: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(own.y.max()) + 1, int(own.x.max()) + 1, len(values)), np.uint8)
        out[own.y.to_numpy(), own.x.to_numpy()] = own[values].to_numpy()
        return pd.DataFrame({**{c: [own[c].iloc[0]] for c in by}, "png": [png(out if len(values) == 3 else out[:, :, 0])]})

    return df.select(*by, "y", "x", *values).groupBy(*by).applyInPandas(one, f"{kinds}, png binary")


def write_png(files: DataFrame, path: str) -> None:
    """Writes files (name string, png binary) as <name>.png into a folder that all machines have mounted.

    Spark has no writer of single files, so each task writes its own; a task that runs again writes the same files again.
    """
    at = path.removeprefix("file://")
    if "://" in at:
        raise ValueError("images are written to a mounted folder")

    def write(rows: Iterator) -> None:
        os.makedirs(at, exist_ok=True)
        for row in rows:
            part = f"{at}/.{row.name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(row.png)
            os.replace(part, f"{at}/{row.name}.png")

    files.select("name", "png").foreachPartition(write)
