"""The log without a broker: exactly once across restarts, batches that run again, aborted tasks, malformed messages, split readers."""

import json
import os
import shutil

import pyarrow as pa
import pytest

from lodestone.sources import log
from lodestone.streaming import jobs


def put(folder, name, ids, extra=()):
    os.makedirs(folder, exist_ok=True)
    lines = [json.dumps({"eventType": "RepositoryCreated", "eventId": f"e{i}", "eventVersion": 1, "timestamp": "2024-01-01T00:00:00Z", "aggregateId": f"a{i % 5}", "organizationId": "o", "payload": "{}"}) for i in ids]
    with open(f"{folder}/{name}.tmp", "w") as f:
        f.write("\n".join([*lines, *extra]) + "\n")
    os.rename(f"{folder}/{name}.tmp", f"{folder}/{name}.json")


def send(spark, base, writer="w"):
    q = log.write_log(jobs.read_events(spark, f"{base}/in"), f"{base}/log", writer, f"{base}/{writer}.checkpoint", 3)
    q.awaitTermination()


def copy(spark, base):
    """What a reader of the stream has kept after this run."""
    rows = log.messages(spark, f"{base}/log")
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/out.checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(json.loads(r["value"])["eventId"] for r in spark.read.parquet(f"{base}/out").collect())


def ids(n):
    return sorted(f"e{i}" for i in range(n))


def test_exactly_once_across_restarts(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", "one", range(10))
    send(spark, base)
    assert copy(spark, base) == ids(10)
    put(f"{base}/in", "two", range(10, 25))
    send(spark, base)
    # the writer died after publishing, before Spark noted it: the batch runs again, and is published once
    commits = f"{base}/w.checkpoint/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for n in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{n}"):
            os.remove(f"{commits}/{n}")
    files = len(os.listdir(f"{base}/log/data"))
    send(spark, base)
    assert len(os.listdir(f"{base}/log/data")) == files
    assert copy(spark, base) == ids(25)
    assert copy(spark, base) == ids(25)
    rows = log.messages(spark, f"{base}/log", stream=False).collect()
    assert len(rows) == 25 and len({(r["partition"], r["writer"], r["batch"], r["key"], r["value"]) for r in rows}) == 25
    assert all(len({r["partition"] for r in rows if r["key"] == k}) == 1 for k in {r["key"] for r in rows})


def test_a_reader_that_runs_a_batch_again(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", "one", range(8))
    send(spark, base)
    assert copy(spark, base) == ids(8)
    shutil.rmtree(f"{base}/out.checkpoint/commits")
    put(f"{base}/in", "two", range(8, 12))
    send(spark, base)
    assert copy(spark, base) in (ids(8), ids(12))  # a run may end after the batch that it repeats
    assert copy(spark, base) == ids(12)


def test_two_writers(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", "one", range(6))
    send(spark, base, "x")
    send(spark, base, "y")
    assert copy(spark, base) == sorted(ids(6) * 2)
    assert {r["writer"] for r in log.messages(spark, f"{base}/log", stream=False).collect()} == {"x", "y"}


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["key", "value"])


def test_failed_tasks_malformed_and_null_messages(spark, tmp_path):
    base = str(tmp_path)
    w = log.LogWriter({"path": base, "writer": "w", "partitions": "2"})
    lost = w.write([batch(("k", "never published"))])
    kept = w.write([batch(("k", "no event"), (None, None)), batch((None, '{"eventId": "e1", "eventType": "T"}'))])
    empty = w.write([])
    assert log.messages(spark, base, stream=False).count() == 0
    w.commit([kept, empty, None], 0)
    w.commit([w.write([batch(("k", "again"))])], 0)
    assert sorted(str(r["value"]) for r in log.messages(spark, base, stream=False).collect()) == ["None", "no event", '{"eventId": "e1", "eventType": "T"}']
    good, bad = log.read_log(spark, base, stream=False)
    assert [r["eventId"] for r in good.collect()] == ["e1"] and sorted(str(r["value"]) for r in bad.collect()) == ["None", "no event"]
    w.abort([lost, None], 1)
    assert sorted(os.listdir(f"{base}/data")) == sorted(n for _, n, _ in kept.files)


def test_readers_are_split(spark, tmp_path):
    base = str(tmp_path)
    w = log.LogWriter({"path": base, "writer": "w", "partitions": "2"})
    for b in range(4):
        w.commit([w.write([batch(*[(f"k{i}", f"{b}-{i}") for i in range(20)])])], b)
    assert log.messages(spark, base, stream=False).rdd.getNumPartitions() == 2
    small = log.messages(spark, base, stream=False, split=1)
    assert small.rdd.getNumPartitions() == 8 and small.count() == 80
    assert len(log._parts(base, {"w": 1}, {"w": 3}, 1)) == 4
    k = [r["value"] for r in small.filter("key = 'k3'").orderBy("batch", "position").collect()]
    assert k == [f"{b}-3" for b in range(4)]


def test_a_stream_without_a_name(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(ValueError):
        log.SharedLog({"path": base}).streamWriter(None, False)
