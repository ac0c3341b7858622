"""Incremental runs: a ledger decides what is new; a stream feeds it batch by batch."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources import storage

LEDGER = "op_name string, input_trace_id string, output_trace_id string"


class Ledger:
    """Outputs and lineage of one operator below ``root``, which become visible together and once.

    A batch writes both tables to a folder of its own and then creates its
    manifest, one small file. Readers take the folders that manifests name, the
    same list for both tables. A run that fails before the manifest leaves
    nothing visible, and the same batch may run again; a batch that has a
    manifest is never run twice. The manifest is created without overwriting,
    so of two runs of one batch one wins.
    """

    def __init__(self, spark: SparkSession, root: str, op_name: str, schema: str):
        self.spark, self.op_name, self.schema = spark, op_name, schema
        self.root = f"{root.rstrip('/')}/{op_name}"
        self.commits_path = f"{self.root}/commits"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Folders of the visible batches."""
        path = self._path(self.commits_path)
        if not self._fs.exists(path):
            return []
        rows = self.spark.read.schema("folder string, replaces array<string>").json(self.commits_path).collect()
        gone = {x for r in rows for x in r.replaces or ()}
        return sorted(r.folder for r in rows if r.folder not in gone)

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.commits_path}/{self._name(batch)}.json"))

    @staticmethod
    def _name(batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()[:32]

    def _table(self, batches: list[str], name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/batches/{b}/{name}" for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def outputs(self) -> DataFrame:
        return self._table(self.batches(), "outputs", self.schema)

    def lineage(self) -> DataFrame:
        return self._table(self.batches(), "lineage", LEDGER)

    def _commit(self, batch: str, folder: str, replaces: list[str]) -> bool:
        """Creates the manifest; False if the batch has one already."""
        final = self._path(f"{self.commits_path}/{self._name(batch)}.json")
        if self._fs.exists(final):
            return False
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"folder": folder, "replaces": replaces}).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        return bool(self._fs.rename(draft, final))

    def _write_outputs(self, new: DataFrame, folder: str) -> None:
        new.drop("source_trace_id").write.parquet(f"{self.root}/batches/{folder}/outputs")

    def _write_lineage(self, new: DataFrame, folder: str) -> None:
        storage.ledger_rows(self.op_name, new, F.col("source_trace_id")).write.parquet(f"{self.root}/batches/{folder}/lineage")

    def run(self, rows: DataFrame, operator: Callable[[DataFrame], DataFrame], *, batch: str | None = None) -> DataFrame:
        """Outputs of all ``rows``: stored ones for known inputs, computed and stored ones for new.

        ``operator`` returns rows with ``source_trace_id`` and ``_trace_id``.
        ``batch`` names the run, so that a repetition of a committed one computes nothing.
        """
        batch = batch or uuid.uuid4().hex
        if not self.committed(batch):
            new = storage.cut_lineage(operator(storage.to_process(rows, self.lineage())))
            folder = uuid.uuid4().hex
            self._write_outputs(new, folder)
            self._write_lineage(new, folder)
            self._commit(batch, folder, [])
            storage.release(new)
        seen = self.batches()
        return storage.recovered(rows, self._table(seen, "lineage", LEDGER), self._table(seen, "outputs", self.schema))

    def compact(self) -> None:
        """One batch instead of many; readers see either the many or the one."""
        old = self.batches()
        if len(old) > 1:
            folder = uuid.uuid4().hex
            for name, schema in (("outputs", self.schema), ("lineage", LEDGER)):
                self._table(old, name, schema).write.parquet(f"{self.root}/batches/{folder}/{name}")
            self._commit(f"compact-{folder}", folder, old)


def stream_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_stream(docs: DataFrame, ledger: Ledger, operator: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Every available micro-batch through the ledger; repeats within and between batches are processed once.

    A micro-batch is named by its checkpoint and number: Spark repeats it with
    the same number after a failure, and the ledger takes it once.
    """

    def each(batch: DataFrame, number: int) -> None:
        ledger.run(batch.dropDuplicates(["_trace_id"]), operator, batch=f"{checkpoint}#{number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
