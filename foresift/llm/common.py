"""Helpers of the training-data operators: tables, row-wise Arrow maps, stored tables, 64-bit hashes of words."""
from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresift.sources.storage import materialise, shared_dir  # noqa: F401

# rows that one Python call sees at once: bounds the memory of very long texts
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    spark_schema = T.StructType.fromDDL(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


def trim_memory() -> None:
    """Gives free memory back to the system; allocators keep it otherwise, and a worker stays as large as its largest slice."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # not every C library has it
    if trim is not None:
        trim(0)


def release_caches() -> None:
    """Workers serve one operator after another: the chunk cache of the tokenizer goes when another one begins."""
    tokens = sys.modules.get("foresift.llm.tokens")
    if tokens is not None and tokens._loaded:
        tokens._loaded.clear()
        gc.collect()
    trim_memory()


def map_rows(df: DataFrame, cols: list[str], ddl: str, make: Callable[[], Callable[[list[list]], list[list]]],
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Applies a function of column lists to slices of rows; make() runs once per task and returns that function."""
    spark_schema, schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = fn([c.to_pylist() for c in part.columns])
                arrays = [pa.array(v, type=f.type) for v, f in zip(out, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, spark_schema)


# any odd multipliers do; fixed so that every worker hashes alike
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        m = max(n, 1 << 16)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _BASE, np.uint64))])
        _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, inv, np.uint64))])
    return _powers, _inverse


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial by prefix sums, shifted to its start, then mixed with its length."""
    power, inverse = _tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=prefix[1:])
    value = (prefix[end] - prefix[start]) * inverse[start]
    return mix64(value ^ (end - start).astype(np.uint64) * _M2)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased and nothing else."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts and word ends; words are split at the ASCII white space 09-0D and 20 (hexadecimal)."""
    data = lower_bytes(text)
    start, end = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))))
    return data, start, end


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence when it has fewer words; empty without words."""
    data, start, end = words_of(text)
    n = len(start)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    words = hash_spans(data, start, end)
    k = min(n, width)
    acc = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        acc = acc * _BASE + words[i:n - k + 1 + i]
    return np.unique(mix64(acc + np.uint64(k)))
