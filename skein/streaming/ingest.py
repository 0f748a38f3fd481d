"""Incremental ingest as streams: late rows, exactly-once snapshots, held cursors."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skein.operators.decisions import RESERVE, UNKNOWN
from skein.operators.lifecycle import upsert
from skein.plans.publish import Files


def timed(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """``ts`` as a timestamp proper: times without a zone cannot carry a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", overlap: str = "60 seconds") -> DataFrame:
    """Rows read again within the overlap count once; state older than it is dropped."""
    return timed(stream, ts).withWatermark(ts, overlap).dropDuplicatesWithinWatermark(keys)


def snapshots(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 16) -> StreamingQuery:
    """Upsert each micro-batch into the table as it was and write what changed. The table is dealt by a hash
    of the keys into ``buckets``; a batch rewrites only those that its rows fall into, as
    ``root/batch=N/bucket=K``, and notes in ``root/batch=N/_table`` which batch holds each bucket. That
    note makes the batch visible: one that is run again writes the same folder from the same
    predecessor and counts once. Folders that no note of the last two batches names are deleted."""

    def write(batch: DataFrame, number: int) -> None:
        spark, files = batch.sparkSession, _Folder(batch.sparkSession, root)
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        hit = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
        before = files.table(number - 1)
        old = [f"{root}/batch={before[k]}/bucket={k}" for k in hit if k in before]
        whole = StructType([*dealt.schema.fields, StructField("batch", IntegerType())])
        last = spark.read.option("basePath", root).schema(whole).parquet(*old).drop("batch") if old else dealt.limit(0)
        made = upsert(last, dealt, keys, order)
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={number}")
        files.note(number, before | dict.fromkeys(hit, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Folder:
    """Notes of a bucketed table: bucket -> the batch whose folder holds it."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names() if n.startswith("batch=") and self.files.exists(f"{n}/_table"))

    def table(self, number: int | None = None) -> dict[int, int]:
        """As of the given batch, or the last whole one before it."""
        done = [n for n in self.batches() if number is None or n <= number]
        return {int(k): v for k, v in json.loads(self.files.read(f"batch={done[-1]}/_table")).items()} if done else {}

    def note(self, number: int, table: dict[int, int]) -> None:
        if self.files.exists(f"batch={number}/_table"):
            self.files.delete(f"batch={number}/_table")
        self.files.create(f"batch={number}/_table", json.dumps(table))
        held = self.batches()[-2:]
        named = {b for n in held for b in self.table(n).values()} | set(held)
        for n in self.batches():
            if n not in named:
                self.files.delete(f"batch={n}")


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The table after the given batch or the last whole one before it; None if there is none."""
    table = _Folder(spark, root).table(number)
    if not table:
        return None
    return spark.read.option("basePath", root).parquet(*(f"{root}/batch={b}/bucket={k}" for k, b in sorted(table.items()))).drop("batch", "bucket")


def bounded(spark: SparkSession, schema, path: str, files: int) -> DataFrame:
    """A resumable scan of at most ``files`` files in each step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class BudgetGate(StatefulProcessor):
    """Per host, the gate of ``decisions.request_gate``: an unknown budget lets one probe through, a known
    one lasts and never grows, a report without a figure blocks, and what is blocked stays so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "remaining long, probed boolean, blocked string")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left, probed, blocked = self.known.get() if self.known.exists() else (None, False, "")
        out = []
        for r in pd.concat(rows).sort_values("seq").itertuples():
            if r.kind == "report":
                if pd.isna(r.remaining):
                    blocked = blocked or UNKNOWN
                elif not blocked:
                    left = int(r.remaining) if left is None else min(left, int(r.remaining))
                continue
            passes = not blocked and (not probed if left is None else left > 0)
            if passes:
                left, probed = (left, True) if left is None else (left - 1, probed)
            elif not blocked:
                blocked = UNKNOWN if left is None else RESERVE
            out.append((key[0], r.seq, passes, None if passes else blocked))
        self.known.update((left, probed, blocked))
        if out:
            yield pd.DataFrame(out, columns=["host", "seq", "passes", "reason"])

    def close(self) -> None:
        pass


def gated(requests: DataFrame) -> DataFrame:
    """requests (host, seq, kind: request or report, remaining) -> host, seq, passes, reason for each
    request."""
    return requests.groupBy("host").transformWithStateInPandas(BudgetGate(), "host string, seq long, passes boolean, reason string", "append", "none")
