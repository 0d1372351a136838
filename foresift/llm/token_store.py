"""Token-id files (operator 5): whole texts as ids, in ascending document order, coded by the adaptive range coder.

Documents are dealt by ranges of their id and sorted; each task writes files of about FILE_IDS ids, whole documents in each.
A file is one binary value: a header, a directory of documents, an index of blocks with word counts and CRC-32 checksums,
and the coded blocks, each of which starts from a fresh model. Files lie in a Parquet table, so that Spark's committer keeps
them whole when an executor is lost and any store that Spark can reach will do. Reading checks every block.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; repeated rows are all written; an empty
table gives an empty store; extra columns are ignored. `start` counts the ids of all earlier documents of the table.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm import range_coder
from foresift.llm.common import SLICE_ROWS, arrow_schema, map_rows, shared_dir
from foresift.llm.tokens import default_path, encoder

MAGIC = b"FSTOKEN1"
HEADER = struct.Struct("<8sIIQQI")          # magic, id bits, block length, documents, ids, blocks
FILE_IDS = 4 << 20
END_ID = 2
ID_BITS = 17


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    coded = range_coder.encode(ids, ID_BITS)
    raw = ids.astype("<u4").tobytes()
    step = range_coder.BLOCK * 4
    crc = np.array([zlib.crc32(raw[i * step:(i + 1) * step]) for i in range(len(coded))], "<u4")
    known = np.array([d is not None for d in doc_ids], "<u1")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([HEADER.pack(MAGIC, ID_BITS, range_coder.BLOCK, len(doc_ids), len(ids), len(coded)), known.tobytes(),
                     names.tobytes(), np.array(lengths, "<u8").tobytes(), np.array([len(c) for c in coded], "<u4").tobytes(),
                     crc.tobytes(), *coded])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids; a damaged block raises."""
    magic, bits, block, docs, n, blocks = HEADER.unpack_from(data)
    if magic != MAGIC or block != range_coder.BLOCK:
        raise ValueError("not a token file of this version")
    at = HEADER.size

    def take(count, kind):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    known, names, lengths = take(docs, "<u1"), take(docs, "<i8"), take(docs, "<u8")
    sizes, crc = take(blocks, "<u4"), take(blocks, "<u4")
    ends = at + np.cumsum(sizes.astype(np.int64))
    ids = range_coder.decode([data[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())], n, bits)
    raw = ids.astype("<u4").tobytes()
    for i, want in enumerate(crc.tolist()):
        if zlib.crc32(raw[i * block * 4:(i + 1) * block * 4]) != want:
            raise ValueError(f"block {i} does not match its checksum")
    return [d if k else None for d, k in zip(names.tolist(), known.tolist())], lengths.astype(np.int64), ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> None:
    tokenizer = tokenizer or default_path()
    schema, arrow = arrow_schema("segment bigint, at bigint, n_docs bigint, n_ids bigint, data binary")
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, segment = encoder(tokenizer), TaskContext.get().partitionId()
        names, parts, total, before = [], [], 0, 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
            data = pack_file(names, [len(p) // 4 for p in parts], ids)
            row = [[segment], [before], [len(names)], [len(ids)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for name, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    names.append(name)
                    parts.append(ids + tail)
                    total += len(ids) // 4 + 1
                    if total >= FILE_IDS:
                        yield flush()
                        names, parts, total, before = [], [], 0, before + total
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema).write \
        .option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document."""
    files = spark.read.parquet(path)
    # one row per segment, which is a shuffle partition of the writer: their number is a setting and no matter of the data
    before, total = {}, 0
    for segment, n in sorted(tuple(r) for r in files.groupBy("segment").agg(F.sum("n_ids")).collect()):
        before[segment], total = total, total + n

    def make():
        def run(cols):
            out = [[], [], [], []]
            for segment, at, data in zip(*cols):
                names, lengths, ids = unpack_file(data)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                out[0] += names
                out[1] += (starts + before[segment] + at).tolist()
                out[2] += lengths.tolist()
                out[3] += [raw[a * 4:b * 4] for a, b in zip(starts.tolist(), ends.tolist())]
            return out
        return run

    # one file at a time: its ids are in memory at once
    return map_rows(files, ["segment", "at", "data"], "doc_id bigint, start bigint, n_tokens bigint, ids binary", make, 1)


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
