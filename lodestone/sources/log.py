"""A log of keyed messages in a shared folder, as a Spark data source and sink for streams: what a broker would hold, without one.

Layout: data/<name>.parquet (key, value, both strings, in the order of their writing), each of one partition; commits/<writer>/<batch>.json names the files
of one batch of one writer, their partitions and rows. A file that no commit names is not part of the log, so tasks that fail or run twice leave
nothing that is seen. A writer is one stream, with one checkpoint; a batch that it runs again after a restart is known by its number and published once.
Offsets are the next batch of each writer, so writers do not wait for each other. Rows of one key lie in one partition, in the order of batches.

Readers get partition, writer, batch, position (of the file's row), key, value, in tasks of whole files up to `splitBytes` of one partition. Paths are what
pyarrow's file systems know (a local or mounted folder, or a URI). A commit is written under another name and then renamed.
"""

import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..operators.events import parse

NAME = "shared_log"
SCHEMA = "partition int, writer string, batch long, position long, key string, value string"
ROWS = pa.schema([("key", pa.string()), ("value", pa.string())])
SPLIT = 128 << 20  # bytes of files that one task reads, at least one file


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


def _names(fs: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)))


def _batches(fs: pafs.FileSystem, root: str, writer: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(fs, f"{root}/commits/{writer}") if n.endswith(".json") and n[:-5].isdigit())


def _ends(path: str) -> dict[str, int]:
    """For each writer the number after its last batch."""
    fs, root = _files(path)
    found = {w: _batches(fs, root, w) for w in _names(fs, f"{root}/commits")}
    return {w: b[-1] + 1 for w, b in found.items() if b}


class Part(InputPartition):
    def __init__(self, partition: int, files: list):
        super().__init__(partition)
        self.partition, self.files = partition, files


def _parts(path: str, start: dict, end: dict, split: int) -> list[Part]:
    """The files of the batches from start up to end, dealt by partition."""
    fs, root = _files(path)
    of: dict[int, list] = {}
    for w, to in sorted(end.items()):
        for b in _batches(fs, root, w):
            if start.get(w, 0) <= b < to:
                with fs.open_input_stream(f"{root}/commits/{w}/{b}.json") as f:
                    for p, name, size in json.loads(f.read())["files"]:
                        of.setdefault(p, []).append((w, b, name, size))
    out = []
    for p, files in sorted(of.items()):
        some, held = [], 0
        for f in files:
            if some and held + f[3] > split:
                out.append(Part(p, some))
                some, held = [], 0
            some.append(f)
            held += f[3]
        out.append(Part(p, some))
    return out


def _rows(path: str, part: Part):
    fs, root = _files(path)
    for w, b, name, _ in part.files:
        at = 0
        with fs.open_input_file(f"{root}/data/{name}") as f:
            for rows in pq.ParquetFile(f).iter_batches(4096):
                n = len(rows)
                ids = [pa.array([part.partition] * n, pa.int32()), pa.array([w] * n, pa.string()), pa.array([b] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*ids, rows.column(0), rows.column(1)], ["partition", "writer", "batch", "position", "key", "value"])
                at += n


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self):
        return _parts(self.path, {}, _ends(self.path), self.split) or [Part(0, [])]

    def read(self, partition):
        return _rows(self.path, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _ends(self.path)

    def partitions(self, start: dict, end: dict):
        return _parts(self.path, start, end, self.split)

    def read(self, partition):
        return _rows(self.path, partition)


class Written(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.writer, self.most = options["path"], options["writer"], int(options.get("partitions", 16))

    def write(self, iterator) -> Written:
        """A file for each partition that the task has rows of; its open files are `partitions` at most."""
        fs, root = _files(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        stem, made = uuid.uuid4().hex, {}
        try:
            for batch in iterator:
                rows = pa.table({"key": batch.column("key"), "value": batch.column("value")}).cast(ROWS)
                of = pa.array([zlib.crc32((k or "").encode()) % self.most for k in rows["key"].to_pylist()], pa.int32())
                for p in pc.unique(of).to_pylist():
                    if p not in made:
                        name = f"{p:05d}-{stem}.parquet"
                        made[p] = (name, pq.ParquetWriter(f"{root}/data/{name}", ROWS, filesystem=fs))
                    made[p][1].write_table(rows.filter(pc.equal(of, p)))
        finally:
            for _, out in made.values():
                out.close()
        return Written([(p, name, fs.get_file_info(f"{root}/data/{name}").size) for p, (name, _) in sorted(made.items())])

    def commit(self, messages, batchId: int) -> None:
        """Publishes a batch, unless it was published before a restart; then what it wrote again goes."""
        fs, root = _files(self.path)
        folder = f"{root}/commits/{self.writer}"
        if batchId in _batches(fs, root, self.writer):
            return self.abort(messages, batchId)
        fs.create_dir(folder, recursive=True)
        hidden = f"{folder}/{batchId}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(hidden) as f:
            f.write(json.dumps({"files": sorted(x for m in messages if m for x in m.files)}).encode())
        fs.move(hidden, f"{folder}/{batchId}.json")

    def abort(self, messages, batchId: int) -> None:
        fs, root = _files(self.path)
        for m in messages:
            for _, name, _ in m.files if m else ():
                fs.delete_file(f"{root}/data/{name}")


class SharedLog(DataSource):
    """Options: path; splitBytes for readers; writer (the name of the stream) and partitions for writers."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        if "writer" not in self.options:
            raise ValueError("option writer must name the stream")
        return LogWriter(self.options)


def messages(spark: SparkSession, path: str, stream: bool = True, split: int = SPLIT) -> DataFrame:
    """All messages of the log, with their places."""
    spark.dataSource.register(SharedLog)
    return (spark.readStream if stream else spark.read).format(NAME).option("splitBytes", split).load(path)


def read_log(spark: SparkSession, path: str, stream: bool = True) -> tuple[DataFrame, DataFrame]:
    """Events, and the messages (value) that are none, for the quarantine."""
    return parse(messages(spark, path, stream).select("value"))


def write_log(events: DataFrame, path: str, writer: str, checkpoint: str, partitions: int = 16):
    """Appends a stream of events, keyed by aggregate, exactly once; ends when all that is there now is written. The number of partitions of a log must stay."""
    events.sparkSession.dataSource.register(SharedLog)
    rows = events.select(F.col("aggregateId").alias("key"), F.to_json(F.struct("*")).alias("value"))
    out = rows.writeStream.format(NAME).option("path", path).option("writer", writer).option("partitions", partitions)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
