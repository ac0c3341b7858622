"""Key-value tables, lineage cuts and file sinks.

A namespace is a Parquet table keyed by ``_trace_id``; operations return new
DataFrames, and a single writer stores them, so no owner process is needed.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "_trace_id"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names it, else the context's own folder; a temporary one only where Spark runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir().get().rstrip("/")


#: Names the folder of this driver's cuts.
_RUN = f"cuts-{uuid.uuid4().hex}"
_folders: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system; at exit the gateway may be gone, and the cluster's cleaner does it."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Whether an execution deletes its shuffle files when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """What ``df`` holds, written to the shared folder and scanned from there.

    The files go with ``release``, or else when the Python driver ends; what was
    shuffled for them goes at once.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/weftgraph/{_RUN}"
    if root not in _folders:
        _folders.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    with _no_shuffles_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables of ``cut_lineage`` that no later step reads."""
    for t in tables:
        for file in t.inputFiles()[:1]:
            _remove(t.sparkSession, file.rsplit("/", 1)[0])


def get_by_ids(table: DataFrame, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows for ``ids`` (ord, _trace_id) in their order; nulls where a key is unknown."""
    wanted = table.select(KEY, *fields) if fields else table
    return ids.join(wanted, KEY, "left").orderBy("ord")


def missing_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(table.select(KEY), KEY, "left_anti")


def upsert_if_absent(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose key the table lacks are added; existing keys keep their rows."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(KEY).orderBy(F.xxhash64(*rows.columns)))).filter("__n = 1").drop("__n")
    return table.unionByName(first.join(table.select(KEY), KEY, "left_anti").select(*rows.columns), allowMissingColumns=True)


def update(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same key."""
    return table.join(rows.select(KEY), KEY, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(KEY), KEY, "left_anti")


def save(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_jsonl(df: DataFrame, output: str, node_id: str) -> DataFrame:
    """Write a node's rows as JSON lines below ``output`` and go on from the files."""
    path = f"{output.rstrip('/')}/{node_id}"
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def save_config(spark: SparkSession, config: dict, output: str) -> None:
    """The run's configuration beside its outputs, as one JSON document."""
    import json

    row = spark.createDataFrame([(json.dumps(config, ensure_ascii=False, default=str),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{output.rstrip('/')}/config")


def to_process(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose key the ledger (op_name, input_trace_id, output_trace_id) lacks."""
    return rows.join(ledger.select(F.col("input_trace_id").alias(KEY)), KEY, "left_anti")


def recovered(rows: DataFrame, ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stored outputs of the rows that the ledger already has."""
    done = ledger.join(rows.select(F.col(KEY).alias("input_trace_id")), "input_trace_id", "left_semi")
    return outputs.join(done.select(F.col("output_trace_id").alias(KEY)).distinct(), KEY, "left_semi")


def ledger_rows(op_name: str, outputs: DataFrame, source: Column) -> DataFrame:
    return outputs.select(F.lit(op_name).alias("op_name"), source.alias("input_trace_id"), F.col(KEY).alias("output_trace_id"))
