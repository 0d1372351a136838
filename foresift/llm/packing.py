"""Sequence packing (operator 7): shortest-pack-first over the length histogram.

Texts become ids with an end id; a document longer than a sequence is cut into full pieces and a rest. The histogram of piece
lengths (at most one bin for each length) goes to the driver, where lengths are placed longest first, each into the packing
pattern with the most room that it fits; patterns carry counts, so the work does not grow with the documents. Each slot of
a pattern then takes a range of the ranks of its length, and pieces meet their slots by rank.

The rank of a piece is the number of equal lengths in earlier partitions plus its place in its own partition, which the
tokenizing task counts: no sort, and a length that a third of the pieces have is spread like all others.

Defined cases: a null or empty text has the end id alone; repeated rows and null ids are packed like others; texts count
whole; an empty table gives no pieces; extra columns are ignored.
"""
from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import SLICE_ROWS, arrow_schema, shared_dir
from foresift.llm.tokens import default_path, encoder

MAX_LENGTH = 4096
END_ID = 2


def plan_patterns(histogram: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[list[int], int]]:
    """Patterns (piece lengths in order) with their counts; shortest pack first, lengths longest first."""
    by_room: list[list] = [[] for _ in range(max_length + 1)]
    top = 0                                     # the most room of any open pattern

    def put(room: int, lengths: list[int], count: int) -> None:
        nonlocal top
        if count:
            by_room[room].append((lengths, count))
            top = max(top, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not by_room[top]:
                top -= 1
            if top >= length:
                room = top
                lengths, count = by_room[room].pop()
                used = min(count, left)
                put(room, lengths, count - used)
                put(room - length, [*lengths, length], used)
                left -= used
            else:                               # new packs take equal lengths as far as they go
                fit = max_length // length
                put(max_length - fit * length, [length] * fit, left // fit)
                put(max_length - left % fit * length, [length] * (left % fit), min(left % fit, 1))
                left = 0
    return sorted((p for patterns in by_room for p in patterns), reverse=True)


def slot_table(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its slots, first sequences and offsets, in rank order."""
    slots, taken, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            slots[length].append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in slots.items()}


def tokenize_pieces(docs: DataFrame, path: str, tokenizer: str | None, max_length: int, end_id: int, id_col: str,
                    text_col: str) -> None:
    """Writes the pieces with their ids, the partition that made them and their place among its pieces of that length."""
    tokenizer = tokenizer or default_path()
    tail = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    schema, arrow = arrow_schema(f"part bigint, place bigint, doc_id {kind}, start bigint, length bigint, doc_tokens bigint, "
                                 "ids binary")

    def run(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                rows = []
                for name, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist())):
                    ids += tail
                    total = len(ids) // 4
                    for start in range(0, total, max_length):
                        n = min(max_length, total - start)
                        rows.append((part, seen[n], name, start, n, total, ids[start * 4:(start + n) * 4]))
                        seen[n] += 1
                cols = list(zip(*rows)) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).write.parquet(path)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset.

    The checksum is taken where the stored pieces are read, so a result without `ids` moves none of them.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    tokenize_pieces(docs, path, tokenizer, max_length, end_id, id_col, text_col)
    pieces = spark.read.parquet(path).withColumn("ids_crc32", F.crc32("ids"))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row for each length at most
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slot_table(plan_patterns(histogram, max_length)))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length, rank):
        import pandas as pd
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for value in np.unique(n):
            at = n == value
            first, start, off = shared.value[int(value)]
            slot = np.searchsorted(first, r[at], "right") - 1
            sequence[at] = start[slot] + r[at] - first[slot]
            offset[at] = off[slot]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(before, ["part", "length"])
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32",
                         place(F.col("length"), F.col("before") + F.col("place")).alias("at")) \
        .select(F.col("doc_id").alias(id_col), "start", "length", "doc_tokens", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def piece_digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
