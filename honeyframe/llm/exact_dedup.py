"""Exact dedup by an extendible-hash index on shared files.

1. Every task scans its rows once and chains equal texts (bytes compared, within
   a bounded cache); it writes a slim row for each document and one *entry* with
   the text for each chain. A text that fills a third of the table leaves a few
   entries for each task.
2. The directory starts with one bucket and doubles while a bucket holds more
   than its capacity; a split only concerns overfull buckets. It is made from
   sums over hash prefixes (at most ``2**max_depth`` of them). Buckets that the
   deepest directory cannot split overflow; they cost time, not memory.
3. Owner tasks each take some buckets, that is, key ranges. They read entries in
   hash order, hold the chain of one hash value at a time, and compare bytes, so
   different texts under one hash value stay apart. Their result is the index.
4. Documents find their group by their entry.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from honeyframe.llm.common import ROW_BITS, Written, widths

_HEAP = (
    "doc_id long, row long, entry long, sha string, h long, text binary, n long, best_row long"
)
_INDEX = "entry long, bucket long, h long, chain int, keep_id long, keep_row long, group_size long"


def _hash(digest: bytes) -> int:
    return struct.unpack("<q", digest[:8])[0]


def _chain_rows(cache_bytes: int):
    """Rows of a task in, documents and entries out."""

    def run(batches):
        base = TaskContext.get().partitionId() << ROW_BITS
        chains: dict[bytes, list] = {}
        held, row = 0, base
        schema = pa.schema([
            ("doc_id", pa.int64()), ("row", pa.int64()), ("entry", pa.int64()), ("sha", pa.string()), ("h", pa.int64()),
            ("text", pa.binary()), ("n", pa.int64()), ("best_row", pa.int64()),
        ])

        def flush():
            rows = [c for chain in chains.values() for c in chain]
            chains.clear()
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([c[2] for c in part], pa.int64()), pa.nulls(len(part), pa.int64()),
                    pa.array([c[1] for c in part], pa.int64()), pa.nulls(len(part), pa.string()),
                    pa.array([c[5] for c in part], pa.int64()), pa.array([c[0] for c in part], pa.binary()),
                    pa.array([c[3] for c in part], pa.int64()), pa.array([c[4] for c in part], pa.int64()),
                ], schema=schema)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            rows, entries, shas, hs = [], [], [], []
            for i, d in enumerate(ids):
                t = texts[i].as_py() or ""
                data = t.encode()
                digest = hashlib.sha256(data).digest()
                chain = chains.setdefault(digest[:8], [])
                for c in chain:
                    if c[0] == data:
                        c[3] += 1
                        if d is not None and (c[2] is None or d > c[2]):
                            c[2], c[4] = d, row
                        break
                else:
                    c = [data, row, d, 1, row, _hash(digest)]
                    chain.append(c)
                    held += len(data) + 200
                rows.append(row)
                entries.append(c[1])
                shas.append(digest.hex())
                hs.append(c[5])
                row += 1
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(entries, pa.int64()), pa.array(shas, pa.string()),
                pa.array(hs, pa.int64()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64()),
            ], schema=schema)
            if held > cache_bytes:
                yield from flush()
                held = 0
        yield from flush()

    return run


def grow_directory(sizes: dict[int, int], top: int, capacity: int) -> list[tuple[int, int]]:
    """Directory over prefixes of ``top`` bits: ``(bucket, local depth)`` for
    each slot. ``sizes`` are bytes by prefix. Each round doubles the directory
    and splits the buckets that are still overfull."""
    directory, depth = [(0, 0)], 0
    while depth < top:
        fill: dict[tuple[int, int], int] = {}
        for prefix, n in sizes.items():
            slot = directory[prefix >> (top - depth)]
            fill[slot] = fill.get(slot, 0) + n
        over = {slot for slot, n in fill.items() if n > capacity and slot[1] == depth}
        if not over:
            break
        depth += 1
        doubled = []
        for i in range(1 << depth):
            bucket, local = directory[i >> 1]
            doubled.append((i, depth) if (bucket, local) in over else (bucket, local))
        directory = doubled
    return [directory[i >> (top - depth)] for i in range(1 << top)] if depth else [(0, 0)] * (1 << top)


def _own(batches):
    """Entries of a task in hash order in, index rows out."""
    schema = pa.schema([
        ("entry", pa.int64()), ("bucket", pa.int64()), ("h", pa.int64()), ("chain", pa.int32()), ("keep_id", pa.int64()),
        ("keep_row", pa.int64()), ("group_size", pa.int64()),
    ])
    now, chain, out = None, [], []

    def close():
        for k, (_, keep, n, entries) in enumerate(chain):
            d, r = keep
            out.extend((e, b, now, k, d, r, n) for e, b in entries)

    def batch():
        cols = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for b in batches:
        for e, bucket, h, d, r, n, text in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6)):
            if h != now:
                close()
                now, chain = h, []
                if len(out) > 20_000:
                    yield batch()
                    out = []
            data = text.as_py()
            rank = (d is not None, d or 0, -r)
            for c in chain:
                if c[0] == data:
                    k = c[1]
                    if rank > (k[0] is not None, k[0] or 0, -k[1]):
                        c[1] = (d, r)
                    c[2] += n
                    c[3].append((e, bucket))
                    break
            else:
                chain.append([data, (d, r), n, [(e, bucket)]])
    close()
    yield batch()


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 1 << 20, max_depth: int = 14,
    cache_bytes: int = 48 << 20, store: Written | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Written slim documents ``(doc_id, row, entry, sha)`` and written index."""
    spark = docs.sparkSession
    store = store or Written(spark)
    heap = store.write(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_chain_rows(cache_bytes), _HEAP)
    )
    entries = heap.where("row is null").withColumn("slot", F.shiftrightunsigned("h", 64 - max_depth))
    sizes = entries.groupBy("slot").agg(F.sum(F.octet_length("text") + 64).alias("bytes")).collect()
    directory = grow_directory({r["slot"]: r["bytes"] for r in sizes}, max_depth, bucket_bytes)
    # one long for each slot, 2**max_depth of them at most: a fixed bound
    lookup = F.broadcast(spark.createDataFrame([(i, b << 8 | d) for i, (b, d) in enumerate(directory)], "slot long, bucket long"))
    index = store.write(
        entries.join(lookup, "slot")
        .select("entry", "bucket", "h", "doc_id", "best_row", "n", "text")
        .repartition(widths(spark), "bucket")
        .sortWithinPartitions("h")
        .mapInArrow(_own, _INDEX)
    )
    return heap.where("row is not null").select("doc_id", "row", "entry", "sha"), index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    Of equal texts the row with the largest id stays, null ids being smallest;
    of repeated rows (same id and text) one stays. A null text is an empty one,
    so null and empty texts are one group. A long text is one entry, compared whole.
    Other columns are not read. An empty table gives an empty result.
    """
    members, index = build_index(docs, id_col, text_col, **options)
    return members.join(index, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id and digest; only rows that repeat under the same
    id and text need one more step that picks one of them.
    """
    found = exact_dedup(docs, id_col, text_col, **options)
    by = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("kept")
    own, key, sha = (f"{name}_{uuid.uuid4().hex}" for name in ("sha", "id", "key"))  # no clash with the columns of docs
    d = docs.withColumn(own, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha))
    single = d.join(by.where("n = 1").select("doc_id", "text_sha256").toDF(key, sha), same, "left_semi")
    again = d.join(by.where("n > 1").select("doc_id", "text_sha256").toDF(key, sha), same, "left_semi").dropDuplicates([id_col, own])
    return single.unionByName(again).drop(own)
