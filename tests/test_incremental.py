"""Incremental folds against the batch folds, retries with timers, quarantine, idle limiter clients, and joins of histories."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import folds, graph, histories
from lodestone.sources.schemas import ENVELOPE
from lodestone.streaming import jobs, retrying
from lodestone.streaming.incremental import EDGES, NODES, SEARCH, Incremental

DAY = datetime.datetime(2024, 1, 1)


def event(kind, n, minute, **payload):
    return (kind, f"e{n}", 1, DAY + datetime.timedelta(minutes=minute), None, payload.get("repositoryId"), "org", json.dumps(payload))


def events():
    """Repositories that share dependencies, developers, commits and documents; one is deleted and made again, one deleted for good."""
    out, n = [], iter(range(10**6))
    for r in "abcd":
        out += [event("RepositoryCreated", next(n), 1, repositoryId=r, name=f"name {r}", url=f"https://x/{r}", language="go")]
        out += [event("DependencyDetected", next(n), 3 + i, repositoryId=r, name=f"lib{i % 2}", version="1", ecosystem="pip", sourceFile=f"{r}{i}.txt") for i in range(3)]
        out += [event("CommitAnalyzed", next(n), 10 + i + ord(r), repositoryId=r, sha=f"s{i}", authorEmail="dev@x", authorName=f"Dev {r}{i}", message=f"fix {r} {i}", filesChanged=["f"] * i) for i in range(2)]
        out += [event("DocumentProcessed", next(n), 20 + ord(r), repositoryId=r, documentId=f"d{r in 'ab'}", fileName=f"{r}.md", documentType="MARKDOWN", chunkCount=1, wordCount=ord(r), textPreview=f"text {r}")]
    out += [event("RepositoryUpdated", next(n), 50, repositoryId="a", changedFields={"name": "renamed"}), event("RepositoryUpdated", next(n), 0, repositoryId="b", changedFields={"name": "too early"})]
    out += [event("RepositoryDeleted", next(n), 300, repositoryId="b"), event("RepositoryCreated", next(n), 301, repositoryId="b", name="again", url="https://x/b2", language="go"), event("RepositoryDeleted", next(n), 310, repositoryId="c")]
    out += [event("DependencyDetected", next(n), 400, repositoryId="b", name="lib1", version="1", ecosystem="pip", sourceFile="late.txt"), event("RepositorySyncRequested", next(n), 5, url="no repository")]
    return out


def as_rows(df):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)


def equal(own, spark, seen):
    log = spark.createDataFrame(seen, ENVELOPE)
    for name, fold in (("nodes", graph.fold_nodes), ("edges", graph.fold_edges), ("search", folds.search_documents)):
        assert as_rows(own.read(name)) == as_rows(fold(log)), name


def test_batches_in_any_order_equal_the_fold(spark, tmp_path):
    every = events()
    random.Random(3).shuffle(every)  # late and out of order throughout
    own = Incremental(spark, str(tmp_path / "s"), {"nodes": NODES, "edges": EDGES, "search": SEARCH}, 4)
    cut = len(every) // 2
    for batch, seen in ((every[:cut], every[:cut]), (every[cut:] + every[:5], every)):  # the second brings some again
        own.take(spark.createDataFrame(batch, ENVELOPE))
        equal(own, spark, seen)
    last = own.versions.newest()[1]["tables"]
    own.take(spark.createDataFrame([event("RepositoryUpdated", 9000, 600, repositoryId="d", changedFields={"name": "last"})], ENVELOPE))
    now = own.versions.newest()[1]["tables"]
    assert sum(last["events"].get(b) != f for b, f in now["events"].items()) == 1  # of the log, the bucket of one repository
    assert own.get("nodes", node_id="d").first()["props"]["name"] == "last"


def test_a_stream_of_events(spark, tmp_path):
    every = events()
    src = tmp_path / "src"
    for i in range(2):
        spark.createDataFrame(every[i::2], ENVELOPE).coalesce(1).write.mode("append").json(str(src))
    own = Incremental(spark, str(tmp_path / "s"), {"nodes": NODES}, 2)
    own.follow(jobs.read_events(spark, str(src), per_trigger=1), str(tmp_path / "c")).awaitTermination(300)
    assert as_rows(own.read("nodes")) == as_rows(graph.fold_nodes(spark.createDataFrame(every, ENVELOPE)))


def test_retries_and_dead_letters(spark, tmp_path):
    """A worker that always fails for one event, and succeeds at the second try for another; the query restarts in between."""
    assert retrying.WAITS == (0.0, 30.0, 120.0, 600.0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retrying.PROVIDER)
    src, out, number = tmp_path / "src", str(tmp_path / "out"), iter(range(1000))
    src.mkdir()

    def put(id_, ok):
        with open(src / f"tmp-{id_}", "w") as f:
            f.write(json.dumps({"eventId": id_, "payload": f"p {id_}", "ok": ok}) + "\n")
        (src / f"tmp-{id_}").rename(src / f"{next(number)}.json")

    def start():
        stream = spark.readStream.schema("eventId string, payload string, ok boolean").option("pathGlobFilter", "*.json").json(str(src))
        return retrying.retries(stream, (0.0, 1.0, 2.0)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def came():
        try:
            return sorted((r["eventId"], r["attempt"], r["outcome"], r["payload"]) for r in spark.read.parquet(out).collect())
        except Exception:  # noqa: BLE001  nothing is written yet
            return []

    try:
        put("bad", False)
        put("good", False)
        q, seen, restarted, end = start(), set(), False, time.time() + 150
        while time.time() < end and not any(r[2] == "dead" for r in seen):
            for r in came():
                if r not in seen:
                    seen.add(r)
                    if r[2] == "retry":
                        put(r[0], r[0] == "good")
                    if r[:2] == ("bad", 2) and not restarted:
                        q.stop()
                        q, restarted = start(), True
            time.sleep(0.2)
        assert q.isActive, q.exception()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert restarted and seen == {("bad", 1, "retry", "p bad"), ("bad", 2, "retry", "p bad"), ("bad", 3, "retry", "p bad"), ("bad", 4, "dead", "p bad"), ("good", 1, "retry", "p good")}
    at = {r["attempt"]: r["at"] for r in spark.read.parquet(out).filter("eventId = 'bad'").collect()}
    assert (at[2] - at[1]).total_seconds() >= 1 and (at[3] - at[2]).total_seconds() >= 2


def test_malformed_lines_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"eventType": "GraphUpdated", "eventId": "1"}\nnot json\n{"eventId": "2"}\n')
    good, bad = jobs.read_lines(spark, str(tmp_path / "in"))
    for name, df in (("good_lines", good), ("bad_lines", bad)):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["eventId"] for r in spark.table("good_lines").collect()] == ["1"]
    assert sorted(r["value"] for r in spark.table("bad_lines").collect()) == ["not json", '{"eventId": "2"}']


def test_idle_clients_are_forgotten(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()

    def put(n, *rows):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"client": c, "request_id": i, "timestamp": t}) for c, i, t in rows))

    put(1, ("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:01"), ("b", 3, "2024-01-01 00:00:02"))
    stream = spark.readStream.schema("client string, request_id int, timestamp timestamp").json(str(src))
    q = jobs.rate_limit(stream, 1, 0.5, idle=1.0).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and (q.lastProgress is None or q.lastProgress["stateOperators"][0]["numRowsTotal"] != 0 or spark.table("idle").count() < 3):
            time.sleep(0.5)
        assert {r["request_id"]: r["admitted"] for r in spark.table("idle").collect()} == {1: True, 2: True, 3: True}
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()


def moment(m):
    return None if m is None else DAY + datetime.timedelta(minutes=m)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_histories(spark, hot):
    r = random.Random(hot)
    versions = [(r.choice("xyz"), r.randrange(0, 400), i) for i in range(60)]
    versions = [(k, f, None if r.random() < 0.2 else f + r.choice([0, 1, 3, 50, 390, -5]), i) for k, f, i in versions] + [(None, 1, 5, 98), ("x", None, 5, 99)]
    asked = [(r.choice("xxxyw"), r.randrange(-5, 450), i) for i in range(80)] + [("x", 7, 500), ("x", 7, 500), (None, 7, 501), ("x", None, 502)]
    h = spark.createDataFrame([(k, moment(f), moment(t), i) for k, f, t, i in versions], "k string, valid_from timestamp, valid_to timestamp, v int")
    m = spark.createDataFrame([(k, moment(a), i) for k, a, i in asked], "k string, at timestamp, i int")
    inside = lambda a, f, t: None not in (a, f) and f <= a and (t is None or a < t)
    want = sorted((i, v) for k, a, i in asked for k2, f, t, v in versions if k is not None and k == k2 and inside(a, f, t))
    assert sorted((x["i"], x["v"]) for x in histories.at_moments(m, h, ["k"], hot=hot).collect()) == want
    outer = histories.at_moments(m, h, ["k"], outer=True, hot=hot).collect()
    assert len(outer) == len(want) + sum(not any(k is not None and k == k2 and inside(a, f, t) for k2, f, t, _ in versions) for k, a, _ in asked)
    real = [(k, f, t, i) for k, f, t, i in versions if k is not None and f is not None and (t is None or t > f)]
    late = lambda *t: min((x for x in t if x is not None), default=None)
    both = sorted(((max(f, f2), late(t, t2) or -1, i, j) for k, f, t, i in real for k2, f2, t2, j in real if k == k2 and (t2 is None or f < t2) and (t is None or f2 < t)))
    other = h.withColumnRenamed("v", "w")
    minutes = lambda x: -1 if x is None else int((x - DAY).total_seconds() // 60)
    assert sorted((minutes(x["valid_from"]), minutes(x["valid_to"]), x["v"], x["w"]) for x in histories.overlaps(h, other, ["k"], hot=hot).collect()) == both
    assert histories.at_moments(m, h.limit(0), ["k"]).count() == 0 and histories.at_moments(m.limit(0), h, ["k"]).count() == 0


def test_deduplicate_without_time_or_id(spark):
    from lodestone.operators import events as E

    rows = [("T", "1", 1, None, None, "a", "o", "late"), ("T", "1", 1, DAY, None, "a", "o", "first"), ("T", "2", 1, None, None, "a", "o", "x"), ("T", None, 1, DAY, None, "a", "o", "n1"), ("T", None, 1, DAY, None, "a", "o", "n2"), ("T", "3", 1, DAY, None, "a", "o", "p"), ("T", "3", 1, DAY, None, "a", "o", "q")]
    got = {tuple(sorted((r["eventId"] or "", r["payload"]) for r in E.deduplicate(spark.createDataFrame(rows, ENVELOPE).repartition(n)).collect())) for n in (1, 3)}
    assert len(got) == 1 and {(i, p) for i, p in next(iter(got)) if i != "3"} == {("1", "first"), ("2", "x"), ("", "n1"), ("", "n2")}


def test_white_space_of_manifests_and_previews(spark):
    from lodestone.functions import manifests
    from lodestone.operators import vectors

    content = "\t# note\n\t-r x.txt\n\t\n \nflask>=2\t\x0cdjango\x1c\tname [x] == 1  # end\n  http://x\n"
    got = manifests.requirements(spark.createDataFrame([("a/requirements.txt", content)], "path string, content string")).collect()
    assert {(r["name"], r["version"]) for r in got} == {("flask", ">=2"), ("django", ""), ("name", "== 1")}
    row = spark.createDataFrame([("d", ["\t", "  ", " real "])], "id string, previews array<string>").select(vectors.chunk_texts(F.col("id"), F.col("previews"), F.lit(None).cast("string"), F.lit(3)).alias("t")).first()
    assert row["t"] == ["d:chunk:0", "d:chunk:1", "real"]
