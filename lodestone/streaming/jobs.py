"""Streaming wrappers: sources, windows with watermarks, deduplication, projections by snapshot, rate limit with state.

A file source stands where a broker would; everything after the source is the same. Each projection is one query with its own
checkpoint, and each calls the batch operators.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import admit, parse
from ..sources.schemas import ENVELOPE, TOPICS

# the events that each projection follows
SUBSCRIPTIONS = {
    "documents": ["RepositoryCreated", "RepositoryDeleted"], "embeddings": ["DocumentProcessed"],
    "graph": ["RepositoryCreated", "RepositoryUpdated", "RepositoryDeleted", "RepositoryCloned", "DocumentProcessed", "DependencyDetected", "CommitAnalyzed"],
    "search": ["RepositoryCreated", "RepositoryUpdated", "RepositoryDeleted", "DocumentProcessed", "DependencyDetected", "CommitAnalyzed"],
    "analyzer": ["RepositoryCreated", "RepositorySyncRequested"], "log": [t[1] for t in TOPICS],
}


def read_events(spark: SparkSession, folder: str, format: str = "json", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(ENVELOPE)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).load(folder)


def read_lines(spark: SparkSession, folder: str, per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of files of JSON lines, and the lines (value) that are none, for the quarantine."""
    reader = spark.readStream.format("text")
    return parse((reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).load(folder))


def read_kafka(spark: SparkSession, servers: str, topics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Events, and the messages (value) that are none. Needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return parse(raw.select(F.col("value").cast("string").alias("value")))


def write_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Keyed by aggregate, so that the events of one keep their order."""
    rows = events.select(F.col("aggregateId").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["eventId"])


def rates(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """late: None where the events have a watermark already."""
    marked = events if late is None else events.withWatermark("timestamp", late)
    counted = marked.groupBy(F.window("timestamp", width).alias("w"), "eventType").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "eventType", "n")


BUCKETS = 64  # folders of the log, by a hash of the key


def project(events: DataFrame, log: str, fold: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kinds: list[str] | None = None, key: tuple | None = None):
    """Appends each batch to the log and writes a new snapshot, out/batch=<id>. A batch that runs again overwrites its own part of the log and
    its own snapshot.

    key: (field of the payload, column of the fold's rows) if the fold's rows of one key follow from the events of that key alone, as those of
    repositories and documents do. Then a batch reads, of the log, the folders that hold its keys, folds their events, and takes all other
    rows from the snapshot before. Without a key the whole log is folded for each batch, which suits short logs only."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        own = df if kinds is None else df.filter(F.col("eventType").isin(kinds))
        own = own.withColumn("key", F.get_json_object("payload", f"$.{key[0]}") if key else F.lit(""))
        own = own.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/batch={number}")
        new = spark.read.schema(own.schema).parquet(f"{log}/batch={number}")
        everything = spark.read.schema(f"{ENVELOPE}, key string, batch long, bucket int").parquet(log).filter(F.col("batch") <= number)
        before = _newest(spark, out, number)
        if key and before is not None:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            keys = new.select("key").filter("key is not null").distinct()
            everything = everything.filter(F.col("bucket").isin(touched)).join(keys, "key", "left_semi")
        rows = fold(everything.drop("batch", "bucket", "key").dropDuplicates(["eventId"]))
        if key and before is not None:
            rows = before.join(keys.withColumnRenamed("key", key[1]), key[1], "left_anti").select(*rows.columns).unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """The snapshot of the last batch before this one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [n for n in (int(x[6:]) for x in names if x.startswith("batch=")) if n < before]
    return spark.read.parquet(f"{out}/batch={max(done)}") if done else None


def rate_limit(requests: DataFrame, limit: int = 120, seconds: float = 60.0, idle: float = 3600.0) -> DataFrame:
    """requests (client, request_id, timestamp): request_id, client, admitted. The state of a client is the times admitted within `seconds`; it goes
    when nothing came from the client for `idle` seconds of the clock (at least `seconds`), after which only requests that came late could need it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "request_id"])
        ok, held = admit(rows["t"].tolist(), limit, seconds, list(state.get[0]) if state.exists else [])
        state.update((held,))
        state.setTimeoutDuration(int(max(idle, seconds) * 1000))
        yield pd.DataFrame({"client": rows["client"], "request_id": rows["request_id"], "admitted": ok})

    kinds = dict(requests.dtypes)
    timed = requests.select("client", "request_id", (F.unix_micros("timestamp") / 1e6).alias("t"))
    return timed.groupBy("client").applyInPandasWithState(run, f"client {kinds['client']}, request_id {kinds['request_id']}, admitted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
