"""Token ids in files of shuffled planes, and the way back.

Layout of one file (numbers little-endian):

    magic "HFP1", block size (u4), width of planes: 8 or 1 bits (u1),
    documents (u8), ids (u8), blocks (u4),
    document ids (i8 each, delta), null flags (u1 each), lengths (u8 each),
        the three together as one zstandard frame behind its size (u8),
    chunk index: for each block its ids (u4) and, for each plane, size (u4),
    the planes, block by block.

A block is a fixed number of ids (the last may hold fewer). Its ids are
transposed: plane k holds byte (or bit) k of every id. Planes of zeros have
size 0; the others are zstandard frames. Blocks can be read one by one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from honeyframe.llm.common import Written
from honeyframe.llm.encoding import WordEncoder, kept

_MAGIC = b"HFP1"
_HEAD = "<4sIBQQI"


def to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return np.ascontiguousarray(raw.T)
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.ascontiguousarray(planes.T)
    else:
        spread = np.unpackbits(planes, axis=1, count=n, bitorder="little")
        raw = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def pack_file(doc_ids: list, lengths: list, ids: bytes, block: int, bits: int, level: int = 3) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    all_ids = np.frombuffer(ids, "<u4")
    known = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    table = np.diff(known, prepend=0).tobytes() + bytes(d is None for d in doc_ids) + np.array(lengths, "<u8").tobytes()
    table = z.compress(table)
    index, body = [], []
    blocks = -(-len(all_ids) // block)
    for k in range(blocks):
        part = all_ids[k * block : (k + 1) * block]
        frames = [z.compress(p.tobytes()) if p.any() else b"" for p in to_planes(part, bits)]
        index.append(struct.pack(f"<{len(frames) + 1}I", len(part), *map(len, frames)))
        body += frames
    head = struct.pack(_HEAD, _MAGIC, block, bits, len(doc_ids), len(all_ids), blocks)
    return b"".join([head, struct.pack("<Q", len(table)), table, *index, *body])


def read_blocks(data: memoryview, at: int, bits: int, blocks: int):
    """Ids of each block in turn, by the chunk index at ``at``."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    planes = 32 // bits
    index = np.frombuffer(data, "<u4", blocks * (planes + 1), at).reshape(blocks, planes + 1)
    at += index.nbytes
    for n, *sizes in index.tolist():
        width = n if bits == 8 else -(-n // 8)
        got = np.zeros((planes, width), np.uint8)
        for k, size in enumerate(sizes):
            if size:
                got[k] = np.frombuffer(z.decompress(data[at : at + size]), np.uint8)
                at += size
        yield from_planes(got, n, bits)


def unpack_file(data: bytes):
    """``(doc_id, ids)`` of each document of a file, in file order."""
    import zstandard

    view = memoryview(data)
    magic, _, bits, docs, _, blocks = struct.unpack_from(_HEAD, view)
    if magic != _MAGIC:
        raise ValueError("not a plane file")
    at = struct.calcsize(_HEAD)
    (size,) = struct.unpack_from("<Q", view, at)
    table = zstandard.ZstdDecompressor().decompress(view[at + 8 : at + 8 + size])
    known = np.cumsum(np.frombuffer(table, "<i8", docs))
    null = np.frombuffer(table, np.uint8, docs, 8 * docs)
    lengths = np.frombuffer(table, "<u8", docs, 9 * docs)
    got = read_blocks(view, at + 8 + size, bits, blocks)
    rest = np.zeros(0, "<u4")
    for d, gone, n in zip(known.tolist(), null.tolist(), lengths.tolist()):
        parts, have = [rest], len(rest)
        while have < n:
            parts.append(next(got))
            have += len(parts[-1])
        joined = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield None if gone else d, joined[:n]
        rest = joined[n:]


def write_planes(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, block: int = 1 << 16, bits: int = 8, file_ids: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode all texts, in ascending id order, into plane files below ``path``.

    Rows are range partitioned and sorted by id, encoded where they land, and
    cut into files of about ``file_ids`` ids, whole documents each. A file is
    the ``payload`` of one row of the output table, so that Spark's committer
    puts it in place on any store, also when a task runs twice.
    """

    def run(batches):
        enc = kept(WordEncoder, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, nr = TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("nr", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        doc_ids, lengths, ids, held = [], [], [], 0

        def cut():
            data = pack_file(doc_ids, lengths, b"".join(ids), block, bits)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([nr], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary()),
            ], schema=schema)

        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                for d, got in zip(s.column(0).to_pylist(), enc.encode(s.column(1))):
                    doc_ids.append(d)
                    lengths.append(len(got) // 4 + 1)
                    ids += [got, end]
                    held += lengths[-1]
                    if held >= file_ids:
                        yield cut()
                        nr, held = nr + 1, 0
                        doc_ids, lengths, ids = [], [], []
        if doc_ids:
            yield cut()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "part int, nr int, n_ids long, payload binary")
        .write.option("compression", "none").parquet(path)
    )


def read_planes(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files below ``path``."""
    files = spark.read.schema("part int, nr int, n_ids long, payload binary").parquet(path)

    def run(batches):
        schema = pa.schema([
            ("part", pa.int32()), ("nr", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
        ])
        for b in batches:
            for p, k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                out, at = [], 0
                for d, ids in unpack_file(data.as_py()):
                    out.append((p, k, d, at, len(ids), zlib.crc32(ids)))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = files.select("part", "nr", "payload").mapInArrow(run, "part int, nr int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each writing task
    by_file = Window.partitionBy("part").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("s")).select("part", F.coalesce(F.sum("s").over(by_part), F.lit(0)).alias("before"))
    starts = (
        files.select("part", "nr", F.coalesce(F.sum("n_ids").over(by_file), F.lit(0)).alias("within")).join(parts, "part")
        .select("part", "nr", (F.col("before") + F.col("within")).alias("file_start"))
    )
    return rows.join(starts, ["part", "nr"]).select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, store: Written | None = None, **options) -> DataFrame:
    """Write all documents and return what the files say.

    A null text is empty and holds the end id alone; null ids come first;
    repeated ids follow each other in the order of their texts; an empty table
    writes no file and reads back as no row; the ids of a long text go on through as
    many blocks as they fill; other columns are not read.
    """
    store = store or Written(docs.sparkSession)
    path = store.path()
    write_planes(docs, tokenizer, path, **options)
    return read_planes(docs.sparkSession, path)
