"""Incremental campaign ingestion and running review state with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filamet.session import find_package

if TYPE_CHECKING:
    import pandas as pd

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -- folders ----------------------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Values of the complete partition folders ``name=<number>`` in a folder."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


# -- incremental campaign ---------------------------------------------------------------------------

class KeyIndex:
    """Keys that have a result, in hash buckets: ``level=<bits>/bucket=<n>/batch=<id>``.

    A batch reads the buckets of its own keys only.  When one of them holds more than ``bucket_keys``
    keys, the index is written anew with twice the buckets, so what a batch reads depends on its own
    keys, not on the history, and the rewriting comes to a constant amount per key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, *, bits: int = 4, bucket_keys: int = 100_000):
        self.spark, self.path, self.key, self.bits, self.bucket_keys = spark, path, key, bits, bucket_keys

    def level(self) -> int:
        return max((n for n in _numbers_marked(self.spark, self.path)), default=self.bits)

    def _bucket(self, level: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(1 << level)).cast("int")

    def _write(self, keys: DataFrame, level: int, mode: str) -> None:
        # a replayed batch overwrites its own folders and no others
        keys.withColumn("bucket", self._bucket(level)).repartition("bucket").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", mode).mode("overwrite").parquet(f"{self.path}/level={level}")

    def buckets_of(self, batch: DataFrame) -> list[str]:
        """Folders of the batch's own buckets, as far as they exist; as many as there are buckets at most."""
        level = self.level()
        own = [r["b"] for r in batch.select(self._bucket(level).alias("b")).distinct().toLocalIterator()]
        return [p for p in (f"{self.path}/level={level}/bucket={b}" for b in sorted(own)) if _exists(self.spark, p)]

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows of the batch whose key no earlier batch has."""
        paths = self.buckets_of(batch)
        if not paths:
            return batch
        seen = self.spark.read.option("basePath", f"{self.path}/level={self.level()}").parquet(*paths)
        return batch.join(seen.where(F.col("batch") < batch_id).select(self.key), self.key, "left_anti")

    def add(self, keys: DataFrame, batch_id: int) -> None:
        level = self.level()
        keys = keys.select(self.key).withColumn("batch", F.lit(batch_id).cast("long"))
        self._write(keys, level, "dynamic")
        _mark(self.spark, f"{self.path}/level={level}")
        paths = self.buckets_of(keys)
        if not paths:
            return
        counts = self.spark.read.option("basePath", f"{self.path}/level={level}").parquet(*paths).groupBy("bucket").agg(F.countDistinct(self.key).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most > self.bucket_keys:
            grown = level
            while most > self.bucket_keys:
                grown, most = grown + 1, most / 2
            every = self.spark.read.parquet(f"{self.path}/level={level}").drop("bucket")
            self._write(every, grown, "static")
            _mark(self.spark, f"{self.path}/level={grown}")
            _delete(self.spark, f"{self.path}/level={level}")


def _mark(spark: SparkSession, path: str) -> None:
    fs, _ = _fs(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_READY")
    if not fs.exists(place):
        fs.mkdirs(place.getParent())
        fs.createNewFile(place)


def _numbers_marked(spark: SparkSession, path: str) -> list[int]:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return [int(n.split("=")[1]) for n in names if n.startswith("level=") and _exists(spark, f"{path}/{n}/_READY")]


def ingest_new(
    spark: SparkSession, source: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], problem: Column, result_path: str, checkpoint: str, *, bucket_keys: int = 100_000,
) -> None:
    """Process only inputs not seen before; an input with a problem becomes a FAILED row.

    ``source`` is a streaming DataFrame.  The checkpoint remembers files, and each batch also
    skips keys that already have a result, so re-delivered inputs are not processed twice.  Those keys
    are in an index beside the results (``<result_path>-keys``, see KeyIndex).  Each batch writes its own
    partition, results first, so replaying a batch overwrites itself.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = KeyIndex(spark, f"{result_path}-keys", key, bucket_keys=bucket_keys)
        fresh = index.unseen(batch.dropDuplicates([key]), batch_id).withColumn("_problem", problem)
        good = process(fresh.where(F.col("_problem").isNull()).drop("_problem")).withColumns({"status": F.lit("COMPLETE"), "error": F.lit(None).cast("string")})
        bad = fresh.where(F.col("_problem").isNotNull()).select(key, F.lit("FAILED").alias("status"), F.col("_problem").alias("error"))
        out = good.unionByName(bad, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{result_path}/batch={batch_id}")
        index.add(spark.read.schema(out.schema).parquet(f"{result_path}/batch={batch_id}"), batch_id)

    query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# -- running review state ---------------------------------------------------------------------------

def review_state(events: DataFrame, case: str, cell: str, status: str, ts: str, tiebreak: str) -> DataFrame:
    """Latest status per case and cell of a table of events."""
    return events.groupBy(case, cell).agg(
        F.max_by(status, F.struct(ts, tiebreak)).alias("status"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("revisions")
    )


def _later(held: tuple | None, now: tuple) -> tuple:
    """The later of two states of a cell (status, time, tiebreak, revisions), with the revisions of both."""
    if held is None:
        return tuple(now)
    late = now if (now[1], now[2]) > (held[1], held[2]) else held
    return (*late[:3], held[3] + now[3])


#: cells of a case that share one state value; further cells have an entry each
FEW_CELLS = 1024


class _ReviewProcessor(StatefulProcessor):
    """Cells of an open case: status, time, tiebreak, revisions and the number of the case's opening.

    Each access to the state is a call to the JVM, so the first FEW_CELLS cells of a case are read and written
    at once.  The batch that brings a closing event ends the case: its cells leave the state.  A later event opens
    it again; its revisions count anew under the next opening, so rows written before stay right.
    """

    def __init__(self) -> None:
        self.few_cells = FEW_CELLS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", "cell array<string>, status array<string>, ts array<bigint>, tie array<bigint>, revisions array<bigint>")
        self.cells = handle.getMapState("cells", "cell string", "status string, ts long, tie long, revisions long")
        self.opening = handle.getValueState("opening", "ts long, tie long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        changed: dict[str, tuple] = {}
        closed, first = False, None
        for frame in rows:
            closed = closed or bool(frame["closes"].any())
            for cell, *now in zip(frame["cell"], frame["status"], frame["ts"].map(int), frame["tie"].map(int), strict=True):
                changed[cell] = _later(changed.get(cell), (*now, 1))
                at = (now[1], now[2])
                first = at if first is None or at < first else first
        if not changed:
            return
        opened = self.opening.get()
        if opened is None:
            opened = first
            self.opening.update(first)
        held = self.few.get()
        few = {cell: tuple(now) for cell, *now in zip(*held, strict=True)} if held else {}
        more = self.cells.exists()
        for cell, now in changed.items():
            if cell not in few and more and self.cells.containsKey((cell,)):
                changed[cell] = _later(self.cells.getValue((cell,)), now)
                self.cells.updateValue((cell,), changed[cell])
            elif cell in few or len(few) < self.few_cells:
                changed[cell] = few[cell] = _later(few.get(cell), now)
            else:
                self.cells.updateValue((cell,), now)
        if closed:
            self.cells.clear()
            self.few.clear()
            self.opening.clear()
        else:
            self.few.update(tuple(list(column) for column in zip(*((cell, *now) for cell, now in few.items()), strict=True)))
        yield pd.DataFrame([(key[0], cell, *row, f"{opened[0]}-{opened[1]}") for cell, row in changed.items()], columns=["case", "cell", "status", "ts", "tie", "revisions", "opening"])

    def close(self) -> None:
        pass


# times are microseconds
STATE = "case string, cell string, status string, ts long, tie long, revisions long, opening string"


def run_review_state(events: DataFrame, case: str, cell: str, status: str, ts: str, tiebreak: str, result_path: str, checkpoint: str, *, closes: Column | None = None) -> dict:
    """Run the state over all events available; each batch writes the rows it changed.

    The state lives in RocksDB and holds the cells of open cases: ``closes`` says which events end their
    case, whose cells then leave the state and stay in the results only.  There is no rule for late
    data, so nothing is dropped by a watermark.  At the end the batches fold into one snapshot, so a
    reader or the next run never meets more than those since.  Events without a case or cell are left
    out.  Returns rows in the state per batch.
    """
    spark = events.sparkSession
    find_package(spark)
    picked = events.where(F.col(case).isNotNull() & F.col(cell).isNotNull()).select(
        F.col(case).cast("string").alias("case"), F.col(cell).cast("string").alias("cell"), F.col(status).alias("status"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"),
        F.col(tiebreak).cast("long").alias("tie"), F.coalesce(F.lit(False) if closes is None else closes, F.lit(False)).alias("closes"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result_path}/changes/batch={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        state = picked.groupBy("case").transformWithStateInPandas(_ReviewProcessor(), STATE, "Update", "None")
        query = state.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    compact_review_state(spark, result_path)
    return {p["batchId"]: sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress}


def _review_rows(spark: SparkSession, result_path: str) -> tuple[DataFrame, int]:
    """Rows of the latest snapshot and the batches after it, one per case, cell and opening; the last batch."""
    upto = max(_numbers(spark, f"{result_path}/snapshot", "upto"), default=-1)
    batches = [b for b in _numbers(spark, f"{result_path}/changes", "batch") if b > upto]
    rows = spark.createDataFrame([], STATE)
    if upto >= 0:
        rows = spark.read.schema(STATE).parquet(f"{result_path}/snapshot/upto={upto}")
    if batches:
        rows = rows.unionByName(spark.read.schema(STATE).parquet(*[f"{result_path}/changes/batch={b}" for b in batches]))
    # revisions of an opening only grow
    latest = rows.groupBy("case", "cell", "opening").agg(F.max_by(F.struct("status", "ts", "tie", "revisions"), "revisions").alias("_s"))
    return latest.select("case", "cell", "opening", "_s.*"), max([upto, *batches])


def compact_review_state(spark: SparkSession, result_path: str) -> None:
    """Fold all complete batches into a snapshot and delete what it replaces; reading is right at every moment."""
    rows, last = _review_rows(spark, result_path)
    old = _numbers(spark, f"{result_path}/snapshot", "upto")
    if last < 0 or last in old:
        return
    rows.write.mode("overwrite").parquet(f"{result_path}/snapshot/upto={last}")
    for b in _numbers(spark, f"{result_path}/changes", "batch"):
        if b < last:  # the last one stays: a restart may write it again
            _delete(spark, f"{result_path}/changes/batch={b}")
    for b in old:
        _delete(spark, f"{result_path}/snapshot/upto={b}")


def read_review_state(spark: SparkSession, result_path: str) -> DataFrame:
    """Current state per case and cell (both as strings): status, last_ts and revisions over all openings."""
    rows, _ = _review_rows(spark, result_path)
    return rows.groupBy("case", "cell").agg(F.max_by("status", F.struct("ts", "tie")).alias("status"), F.timestamp_micros(F.max("ts")).alias("last_ts"), F.sum("revisions").alias("revisions"))
