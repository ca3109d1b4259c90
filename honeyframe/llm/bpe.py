"""Byte-level BPE ids of whole texts and the way back, in Arrow batches."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honeyframe.llm.encoding import ByteEncoder, kept

_SLICE = 256


def _arrow(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``doc_id, ids`` and, on request, ``byte_start, char_start`` of each token.

    Each match of the pattern is encoded on its own, without special tokens; a
    null text is an empty one and has no ids. A long text is one row.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    if offsets:
        fields += [("byte_start", pa.list_(pa.int64())), ("char_start", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches):
        enc = kept(ByteEncoder, ranks, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                part = b.slice(lo, _SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = enc.encode(texts)
                cols = [part.column(0).to_pylist(), [i.astype("i4") for i in ids]]
                if offsets:
                    spans = [enc.offsets(i, t.encode()) for i, t in zip(ids, texts)]
                    cols += [[s[0] for s in spans], [s[1] for s in spans]]
                yield _arrow(cols, schema)

    ddl = "doc_id long, ids array<int>" + (", byte_start array<long>, char_start array<long>" if offsets else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes of each row's ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        enc = kept(ByteEncoder, ranks, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                part = b.slice(lo, _SLICE)
                ids = [part.column(1)[i].values.to_numpy(zero_copy_only=False) for i in range(part.num_rows)]
                yield _arrow([part.column(0).to_pylist(), [enc.decode(i) for i in ids]], schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of
    what they decode to, made in one pass. Null and empty texts have no tokens
    and the digests of nothing; repeated rows give repeated rows; a long text is encoded
    whole, part by part; other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc = kept(ByteEncoder, ranks, pattern)
        names = list(map(str, range(len(enc.bytes_of))))
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                (ids,) = enc.encode([t.as_py()])
                said = ",".join(map(names.__getitem__, ids.tolist())).encode()
                out.append((d, len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()))
            yield _arrow(list(zip(*out)) or [()] * 4, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
