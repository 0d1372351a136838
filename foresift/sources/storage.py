"""Result sink with provenance, and materialisation of iterated inputs in the cluster's shared folder."""
from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}      # application id -> local folder, for sessions without the setting


def shared_dir(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; only where it is unset in local mode (tests) a new local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _FALLBACK.get(spark.sparkContext.applicationId)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _FALLBACK[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
JIT_LIMIT = "8000"      # HotSpot interprets methods of more bytecodes for good


@contextmanager
def compiled_methods(spark: SparkSession):
    """While it runs, no stage is generated as one method that HotSpot would never compile (wide rows of scores are such stages)."""
    before = spark.conf.get(HUGE_METHOD, None)
    spark.conf.set(HUGE_METHOD, JIT_LIMIT)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(HUGE_METHOD)
        else:
            spark.conf.set(HUGE_METHOD, before)


def materialise(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with compiled_methods(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, keys: list[str], n_buckets: int) -> DataFrame:
    """`materialise` as a table in buckets of `keys` (in the warehouse): grouping or cogrouping by them shuffles it no more.

    A table with fewer buckets than shuffle partitions would be shuffled for the sake of parallelism.
    """
    spark = df.sparkSession
    n = max(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"table_{uuid.uuid4().hex}"
    with compiled_methods(spark):
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).saveAsTable(name)
    return spark.table(name)


def config_hash(config: dict) -> str:
    """First 16 hex digits of SHA-256 over key-sorted JSON; independent of key order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_result(df: DataFrame, name: str, model_version: str, config: dict, out_dir: str,
                 mode: str = "errorifexists") -> None:
    """Writes `<out_dir>/<name>` and a one-row JSON sidecar `<out_dir>/<name>.meta`."""
    df.write.mode(mode).parquet(f"{out_dir}/{name}")
    meta = df.sparkSession.range(1).select(
        F.lit(model_version).alias("model_version"), F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"),
        F.lit(config_hash(config)).alias("config_hash"), F.current_timestamp().alias("written_at"))
    meta.write.mode(mode).json(f"{out_dir}/{name}.meta")


def read_result(spark: SparkSession, name: str, out_dir: str) -> tuple[DataFrame, DataFrame]:
    meta_schema = "model_version string, config string, config_hash string, written_at timestamp"
    return spark.read.parquet(f"{out_dir}/{name}"), spark.read.schema(meta_schema).json(f"{out_dir}/{name}.meta")


def write_by_method(df: DataFrame, path: str) -> None:
    """A prediction table with one folder for each method."""
    df.write.partitionBy("method").parquet(path)


def replace_methods(new: DataFrame, methods: list[str], path: str) -> None:
    """Replaces the stored rows of the given methods by `new`; the files of all other methods stay as they are.

    Only the folders of the methods in `new` are written (dynamic partition overwrite); a given method without new rows loses its
    folder. Rows of other methods in `new` are an error, since they would replace what is to stay.
    """
    spark = new.sparkSession
    stored = spark.read.parquet(path)
    if sorted(stored.columns) != sorted(new.columns):
        raise ValueError("both tables must have the same columns")
    found = {r["method"] for r in new.select("method").distinct().limit(len(methods) + 1).collect()}
    if not found <= set(methods):
        raise ValueError(f"rows of methods that are not to be replaced: {sorted(map(str, found - set(methods)))}")
    new.select(*stored.columns).write.partitionBy("method").option("partitionOverwriteMode", "dynamic") \
        .mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    for gone in sorted(set(methods) - found):
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("method", gone)
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
