"""A resumable append: batches of accepted and rejected rows that are published together, once.

A batch is written to a folder of its own; then one small file in the ledger names that
folder.  Readers open only folders that the ledger names.  So a batch whose writer dies
before that file is there is not seen, and is written anew when it is offered again; one
whose file is there is left as it is.  All files go through Spark's own file systems.

``stream_into`` feeds a ledger from a stream, whose checkpoint offers a batch again
after a crash under the same number and with the same rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Rules:
    """What a batch's rows become.  key: of which the sink holds one row, the first by
    ``order`` of the first batch that has it.  reason: why a row is rejected, null if it
    is accepted."""

    key: str
    order: tuple[str, ...]
    reason: Column


class Ledger:
    """A sink below ``root``: accepted and rejected rows by published batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def entries(self) -> list[dict]:
        """Published batches that no compaction has taken in, in order: one small row a batch."""
        names = [f"{self.root}/ledger/{n}" for n in self._list("ledger") if n.endswith(".json")]
        found = [json.loads(r.value) for r in self.spark.read.text(names, wholetext=True).collect()] if names else []
        upto = max((e["upto"] for e in found if "upto" in e), default=-1)
        return sorted((e for e in found if e.get("upto") == upto or "upto" not in e and e["batch"] > upto), key=lambda e: e["batch"])

    def read(self, kind: str = "accepted") -> DataFrame | None:
        """All published rows of a kind (accepted or rejected) with their batch; None before the first batch."""
        folders = [f"{self.root}/batches/{e['folder']}" for e in self.entries()]
        if not folders:
            return None
        parts = self.spark.read.option("basePath", f"{self.root}/batches").parquet(*(f"{f}/rows" for f in folders))
        return parts.where(F.col("_rejected") if kind == "rejected" else ~F.col("_rejected")).drop("_rejected", *(["reject_reason"] if kind != "rejected" else []))

    def _publish(self, entry: dict, name: str) -> bool:
        """Name a folder in the ledger; false if the name is taken."""
        own = self._path(f"{self.root}/ledger/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/ledger/{name}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(own, final):
            self._fs.delete(own, False)
            return False
        return True

    def append(self, df: DataFrame, batch: int, rules: Rules, before_publish: Callable[[], None] | None = None) -> bool:
        """Publish a batch: its rows of keys that the sink lacks, one a key; false if it was published before.

        Rows with a null key are rejected as such and are never one row."""
        held = self.entries()
        if any(e.get("upto", e["batch"]) >= batch if "upto" in e else e["batch"] == batch for e in held):
            return False
        key, columns = F.col(rules.key), df.columns
        order = F.struct(*rules.order, *(c for c in columns if c not in (*rules.order, rules.key)))
        fresh = df.where(key.isNotNull()).groupBy(rules.key).agg(F.min(order).alias("_row")).select(rules.key, "_row.*").select(*columns)
        if held:
            done = self.spark.read.parquet(*(f"{self.root}/batches/{e['folder']}/rows" for e in held))
            fresh = fresh.join(done.select(rules.key), rules.key, "left_anti").select(*columns)
        reason = rules.reason.cast("string")
        rows = fresh.withColumn("reject_reason", reason).unionByName(df.where(key.isNull()).withColumn("reject_reason", F.lit("no key")))
        rows = rows.withColumn("_rejected", F.col("reject_reason").isNotNull()).withColumn("batch", F.lit(batch).cast("long"))
        folder = f"{batch:020d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/batches/{folder}/rows")
        if before_publish:
            before_publish()
        told = self._publish({"batch": batch, "folder": folder}, f"{batch:020d}")
        for name in self._list("batches"):  # what killed writers of this batch have left
            if name.startswith(f"{batch:020d}-") and (name != folder or not told):
                if not told and name in {e["folder"] for e in self.entries()}:
                    continue
                self._fs.delete(self._path(f"{self.root}/batches/{name}"), True)
        return told

    def compact(self) -> None:
        """Rewrite all published batches as one folder; rows keep their batch.  Older folders go after the ledger names the new one."""
        held = self.entries()
        if len(held) < 2:
            return
        upto, folder = held[-1]["batch"], f"upto-{held[-1]['batch']:020d}-{uuid.uuid4().hex[:12]}"
        self.spark.read.parquet(*(f"{self.root}/batches/{e['folder']}/rows" for e in held)).write.parquet(f"{self.root}/batches/{folder}/rows")
        if self._publish({"batch": upto, "upto": upto, "folder": folder}, f"upto-{upto:020d}"):
            for e in held:
                self._fs.delete(self._path(f"{self.root}/batches/{e['folder']}"), True)


def stream_into(stream: DataFrame, ledger: Ledger, rules: Rules, checkpoint: str, before_publish: Callable[[], None] | None = None) -> StreamingQuery:
    """Append what the stream has now, batch by batch; a later call goes on where this one ended."""
    write = stream.writeStream.foreachBatch(lambda df, batch: ledger.append(df, batch, rules, before_publish) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
