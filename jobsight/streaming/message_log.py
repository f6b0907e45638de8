"""An append-only message log as a streaming source with offsets.

The log is a folder of segment files ``<first offset>-<messages>.jsonl``, one line a
message. ``publish`` adds a table of messages: Spark writes the parts aside, and each
part gets its place by a rename, in the order of its offsets, so a reader never
sees a gap. ``MessageLog`` (format ``message_log`` once ``register`` ran) reads it as a
topic is read:

* ``startingOffsets``: ``latest`` (the default: what was there is skipped), ``earliest`` or
  an offset; a restarted query goes on where its checkpoint stands.
* ``failOnDataLoss`` (``true`` unless said otherwise): segments that retention removed
  before they were read stop the query, or are left out.
* ``maxOffsetsPerTrigger`` bounds a micro-batch. The source is not told where a
  restarted query stands, so it keeps the last offset it planned in the folder
  ``progress`` (needed with this option); after a crash between planning and logging a
  batch, one batch may hold what two would have.

Each task reads one segment (or the part of it that a batch takes), line by line.
"""

from __future__ import annotations

import sys
import uuid
from typing import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ROWS = "value string, offset long"
_BATCH = 4096


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """(first offset, messages, file name) of the log, in order, up to the first gap."""
    from pyarrow import fs

    store, place = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.endswith(".jsonl") and not info.base_name.startswith((".", "_")):
            first, count = info.base_name.removesuffix(".jsonl").split("-")
            found.append((int(first), int(count), info.base_name))
    found.sort()
    for i in range(1, len(found)):
        if found[i][0] != found[i - 1][0] + found[i - 1][1]:
            return found[:i]
    return found


def log_end(path: str) -> int:
    found = segments(path)
    return found[-1][0] + found[-1][1] if found else 0


def publish(events: DataFrame, path: str) -> int:
    """Appends ``events.value`` (null ones are left out, as a topic's tombstones are no
    events); returns the log's end. One publisher at a time."""
    spark = events.sparkSession
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    events.where("value IS NOT NULL").select("value").write.text(staging)
    counts = (spark.read.text(staging).groupBy(F.col("_metadata.file_name").alias("name")).count()
              .orderBy("name").collect())                  # a row a written part
    at = log_end(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, count in counts:
        if not store.rename(hadoop(f"{staging}/{name}"), hadoop(f"{path.rstrip('/')}/{at:020d}-{count}.jsonl")):
            raise RuntimeError(f"cannot put messages at offset {at} of {path}")
        at += count
    store.delete(hadoop(staging), True)
    return at


class Segment(InputPartition):
    """Messages ``lo`` to ``hi`` (exclusive) of one file."""

    def __init__(self, file: str, first: int, lo: int, hi: int):
        super().__init__(None)
        self.file, self.first, self.lo, self.hi = file, first, lo, hi


class MessageLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.starting = options.get("startingOffsets", "latest")
        self.fail = options.get("failOnDataLoss", "true").lower() == "true"
        self.most = int(options["maxOffsetsPerTrigger"]) if options.get("maxOffsetsPerTrigger") else None
        self.progress = (options.get("progress") or "").rstrip("/")
        if self.most is not None and (self.most < 1 or not self.progress):
            raise ValueError("maxOffsetsPerTrigger needs a positive number and a progress folder")
        self.initial = self.planned = self.taken = None

    def initialOffset(self) -> dict:
        if self.initial is None:
            found = segments(self.path)
            if self.starting == "latest":
                self.initial = found[-1][0] + found[-1][1] if found else 0
            elif self.starting == "earliest":
                self.initial = found[0][0] if found else 0
            else:
                self.initial = int(self.starting)
        return {"offset": self.initial}

    def latestOffset(self) -> dict:
        end = log_end(self.path)
        if self.most is None:
            return {"offset": max(end, self.initialOffset()["offset"]) if self.initial is not None else end}
        if self.planned is None:                           # a new run: where the last one planned to be
            kept = self._kept()
            self.planned = self.taken = kept if kept is not None else self.initialOffset()["offset"]
        if self.taken is not None and self.taken >= self.planned and end > self.planned:
            self.planned = min(end, self.planned + self.most)
            self._keep(self.planned)
        return {"offset": self.planned}

    def _kept(self) -> int | None:
        from pyarrow import fs

        store, place = _store(f"{self.progress}/planned")
        if store.get_file_info(place).type != fs.FileType.File:
            return None
        with store.open_input_stream(place) as f:
            return int(f.read())

    def _keep(self, offset: int) -> None:
        store, place = _store(f"{self.progress}/planned")
        store.create_dir(_store(self.progress)[1], recursive=True)
        aside = f"{place}-{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(aside) as f:
            f.write(str(offset).encode())
        store.move(aside, place)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = start["offset"], end["offset"]
        self.taken = max(self.taken or 0, hi)
        if lo >= hi:
            return []
        out = [Segment(f"{self.path}/{name}", first, max(lo, first), min(hi, first + count))
               for first, count, name in segments(self.path) if first < hi and first + count > lo]
        there = sum(s.hi - s.lo for s in out)
        if there < hi - lo and self.fail:
            raise RuntimeError(f"{hi - lo - there} of the messages {lo} to {hi} are gone; failOnDataLoss=false leaves them out")
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import io

        import pyarrow as pa

        store, place = _store(partition.file)
        at, values, offsets = partition.first, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(offsets, pa.int64())], ["value", "offset"])

        with store.open_input_file(place) as raw, io.BufferedReader(raw) as lines:
            for line in lines:
                if at >= partition.hi:
                    break
                if at >= partition.lo:
                    values.append(line.rstrip(b"\n").decode())
                    offsets.append(at)
                    if len(values) >= _BATCH:
                        yield batch()
                        values, offsets = [], []
                at += 1
        if values:
            yield batch()


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> MessageLogReader:
        return MessageLogReader(self.options)


# executors need pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)


def log_job_stream(spark: SparkSession, path: str, starting: str = "latest", fail_on_data_loss: bool = False,
                   max_offsets_per_trigger: int | None = None, progress: str | None = None) -> DataFrame:
    """S6 with the live job's options (start at latest, lost data tolerated)."""
    register(spark)
    r = (spark.readStream.format("message_log").option("path", path).option("startingOffsets", starting)
         .option("failOnDataLoss", str(fail_on_data_loss).lower()))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger)).option("progress", progress or "")
    return r.load()
