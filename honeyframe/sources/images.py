"""Gray images as pixel rows.

The decoder reads uncompressed gray TIFF pages of 8, 16 or 32 bits; it is the
one Python function on the read path. Rows leave it in blocks, so a large
image is never one batch.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "name string, page int, x int, y int, value double, ok boolean"
_ROWS = 1 << 17


def decode_pages(data: bytes):
    """Yield the pages of a TIFF file as arrays; ValueError if not supported."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    sizes = {1: "B", 3: "H", 4: "I"}
    while at:
        count = struct.unpack(order + "H", data[at:at + 2])[0]
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i:at + 10 + 12 * i])
            if kind not in sizes:
                continue
            fmt = order + str(n) + sizes[kind]
            size = struct.calcsize(fmt)
            pos = at + 10 + 12 * i
            if size > 4:
                pos = struct.unpack(order + "I", data[pos:pos + 4])[0]
            tags[tag] = struct.unpack(fmt, data[pos:pos + size])
        # fixed values: tag numbers of the TIFF format
        width, height, bits = tags[256][0], tags[257][0], tags.get(258, (1,))[0]
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1 or bits not in (8, 16, 32):
            raise ValueError("unsupported TIFF page")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        raw = b"".join(data[o:o + n] for o, n in zip(tags[273], tags[279]))
        yield np.frombuffer(raw, dtype=np.dtype(f"{order}{kind}{bits // 8}"), count=width * height).reshape(height, width)
        at = struct.unpack(order + "I", data[at + 2 + 12 * count:at + 6 + 12 * count])[0]


def encode_page(image: np.ndarray) -> bytes:
    """One gray page, little endian, one strip."""
    image = np.ascontiguousarray(image)
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    raw = image.astype(image.dtype.newbyteorder("<")).tobytes()
    h, w = image.shape
    tags = [(256, w), (257, h), (258, image.dtype.itemsize * 8), (259, 1), (262, 1), (273, 8), (277, 1), (278, h), (279, len(raw)), (339, kind)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + ifd


def _rows(name: str, data: bytes, shape):
    try:
        pages = list(decode_pages(data))
        if shape is not None and any(p.shape != shape for p in pages):
            raise ValueError("shape")
    except (ValueError, KeyError, struct.error):
        yield pd.DataFrame({"name": [name], "page": [0], "x": [None], "y": [None], "value": [None], "ok": [False]}).astype(
            {"page": "int32", "x": "Int32", "y": "Int32", "value": "float64"})
        return
    for k, p in enumerate(pages):
        flat, w = p.reshape(-1), p.shape[1]
        for a in range(0, flat.size, _ROWS):
            at = np.arange(a, min(a + _ROWS, flat.size))
            yield pd.DataFrame({
                "name": name, "page": np.int32(k), "x": (at % w).astype("int32"), "y": (at // w).astype("int32"),
                "value": flat[at].astype("float64"), "ok": True,
            })


def scan_images(spark: SparkSession, path: str, pattern: str = ".*", shape: tuple[int, int] | None = None) -> DataFrame:
    """Pixel rows (name, page, x, y, value, ok) of all files in a folder whose
    name matches ``pattern``. A file that cannot be read, or has another
    (height, width), gives one row with ok = false."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(name.alias("name"), "content").filter(F.col("name").rlike(pattern))

    def decode(batches):
        for b in batches:
            for n, data in zip(b["name"], b["content"]):
                yield from _rows(n, data, shape)

    return files.mapInPandas(decode, SCHEMA)


def write_images(pixels: DataFrame, path: str, width: int, height: int) -> DataFrame:
    """Write each frame (frame_id, x, y, value) as a 16-bit page named by its
    id in a folder all workers share; gives the names written."""
    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        values = pdf["value"].to_numpy()
        if not np.array_equal(values, np.clip(np.nan_to_num(values), 0, 65535).astype("uint16")):
            raise ValueError("a 16-bit image holds whole numbers from 0 to 65535 only")
        image = np.zeros((height, width), dtype="uint16")
        image[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = values
        name = f"{int(pdf['frame_id'].iloc[0]):08d}.tif"
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(encode_page(image))
        return pd.DataFrame({"name": [name]})

    return pixels.select("frame_id", "x", "y", "value").groupBy("frame_id").applyInPandas(save, "name string")
