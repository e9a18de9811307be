"""Folds, log, rate limit and streaming."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import events as E
from lodestone.operators import folds, graph
from lodestone.sources.schemas import ENVELOPE
from lodestone.streaming import jobs


def envelope(n, kind, minute, **payload):
    return {"eventType": kind, "eventId": f"e{n:03}", "eventVersion": 1, "timestamp": f"2024-01-01T00:{minute:02}:00Z", "correlationId": "c", "aggregateId": payload.get("repositoryId", ""), "organizationId": "o", "payload": json.dumps(payload)}


LOG = [
    envelope(1, "RepositoryCreated", 1, repositoryId="r1", name="payment-gateway", url="https://x.org/1", language="Go", visibility="private", defaultBranch="main"),
    envelope(2, "RepositoryUpdated", 2, repositoryId="r1", changedFields={"visibility": "public"}),
    envelope(3, "DependencyDetected", 3, repositoryId="r1", name="requests", version="2.31.0", ecosystem="pip", sourceFile="requirements.txt"),
    envelope(4, "DocumentProcessed", 0, documentId="d0", repositoryId="r1", fileName="openapi-spec", documentType="TEXT"),
    envelope(5, "DocumentProcessed", 4, documentId="d1", repositoryId="r1", fileName="a.md", textPreview="kubernetes autoscaling ingress"),
    envelope(6, "CommitAnalyzed", 5, repositoryId="r1", sha="abc", authorEmail="a@x.org", authorName="A", message="feat: implement circuit breaker pattern", filesChanged=["a", "b"]),
    envelope(7, "RepositoryUpdated", 6, repositoryId="unknown", changedFields={"name": "x"}), envelope(8, "RepositoryUpdated", 6, repositoryId="r1", changedFields={}),
    envelope(9, "RepositoryCreated", 7, repositoryId="r2", name="other", url="https://x.org/1"), envelope(10, "RepositoryCreated", 8, repositoryId="r3", name="bad", url="nope"),
    envelope(11, "RepositoryCreated", 9, repositoryId="r4", name="gone", url="https://x.org/4"), envelope(12, "RepositoryDeleted", 10, repositoryId="r4"),
    envelope(13, "RepositoryCreated", 11, repositoryId="r5", name="old", url="https://x.org/5"), envelope(14, "RepositoryDeleted", 12, repositoryId="r5"),
    envelope(15, "RepositoryCreated", 13, repositoryId="r5", name="new", url="https://x.org/5"), envelope(16, "RepositoryCloned", 14, repositoryId="r1", commitCount=3, sizeKb=9, clonedAt="t"),
]


@pytest.fixture(scope="module")
def log(spark):
    lines = spark.createDataFrame([(json.dumps(e),) for e in LOG] + [("{broken",), ('{"x": 1}',)], "value string")
    good, bad = E.parse(lines)
    assert bad.count() == 2 and good.count() == len(LOG)
    return good.cache()


def test_nodes(log):
    n = {r["node_id"]: r for r in graph.fold_nodes(log).collect()}
    assert set(n) == {"r1", "r2", "r3", "r5", "d0", "d1", "dep:pip:requests:2.31.0", "commit:abc", "developer:a@x.org"}
    p = n["r1"]["props"]
    assert (p["name"], p["visibility"], p["commitCount"], p["cloneStatus"], p["organizationId"]) == ("payment-gateway", "public", "3", "success", "o")
    assert n["r5"]["props"]["name"] == "new" and n["r5"]["created_at"].minute == 13 and n["commit:abc"]["props"]["filesChanged"] == "2"


def test_edges(log):
    e = {(r["from_id"], r["to_id"], r["type"]) for r in graph.fold_edges(log).collect()}
    late = ("d0", "r1", "DESCRIBES")
    assert e == {("r1", "dep:pip:requests:2.31.0", "DEPENDS_ON"), ("d1", "r1", "DESCRIBES"), ("commit:abc", "r1", "COMMITTED_TO"), ("developer:a@x.org", "commit:abc", "AUTHORED_BY")}
    assert {(r["from_id"], r["to_id"], r["type"]) for r in graph.fold_edges(log, eventual=True).collect()} == e | {late}
    u = {r["eventId"]: (r["nodes_created"], r["relationships_created"]) for r in graph.graph_updates(log).collect()}
    assert u["e006"] == (2, 2) and u["e004"] == (1, 0) and u["e002"] == (0, 0) and "e012" not in u


def test_reads(log, spark):
    n, e = graph.fold_nodes(log), graph.fold_edges(log)
    assert {r["label"] for r in graph.list_nodes(n, "Repository").collect()} == {"Repository"}
    with pytest.raises(ValueError):
        graph.list_nodes(n, "INVALID_LABEL")
    left, edges = graph.detach_delete(n, e, spark.createDataFrame([("r1",)], "node_id string"))
    assert "r1" not in {r["node_id"] for r in left.collect()} and edges.count() == 1
    assert {r["node_id"] for r in graph.gaps(n, e, "Repository", "DESCRIBES").collect()} == {"r2", "r3", "r5"}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_id string, to_id string")
    assert {(r["node_id"], r["length"]) for r in graph.in_cycles(ring, 5).collect()} == {("a", 3), ("b", 3), ("c", 3)}
    far = graph.reach(ring, spark.createDataFrame([("a",)], "start string"), 10)
    assert {(r["node_id"], r["hops"]) for r in far.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_paths_and_patterns(log, spark):
    n, e = graph.fold_nodes(log), graph.fold_edges(log)
    met = graph.match(n, e, "AUTHORED_BY", "Developer", "Commit").collect()
    assert [(r["from_id"], r["to_id"], r["from_props"]["name"], r["to_label"]) for r in met] == [("developer:a@x.org", "commit:abc", "A", "Commit")]
    start = spark.createDataFrame([("developer:a@x.org",)], "start string")
    assert [r["node_id"] for r in graph.walk(e, start, ["AUTHORED_BY", "COMMITTED_TO"]).collect()] == ["r1"]
    ring = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "a"), ("d", "y")], "from_id string, to_id string")
    got = {r["node_id"]: r["path"] for r in graph.paths(ring, spark.createDataFrame([("a",)], "start string"), 5).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"], "y": ["a", "b", "d", "y"]}
    assert {(r["node_id"], r["length"]) for r in graph.in_cycles(ring, 5).collect()} == {(x, 3) for x in "abcd"}
    scores = spark.createDataFrame([("a", 0.8), ("d", 0.1)], "node_id string, confidence double")
    assert {r["node_id"]: r["confidence"] for r in graph.propagate(scores, ring, 0.5, 2).collect()} == {"a": 0.8, "b": 0.4, "c": 0.4, "d": 0.2, "y": 0.05}
    hot = graph.hotspots(graph.degrees(spark.createDataFrame([("a",), ("b",)], "node_id string"), ring), 2, 4).collect()
    assert [(r["node_id"], r["critical"], r["god_object"]) for r in hot] == [("a", True, True)]


def test_derived_edges_of_a_hot_node(spark):
    """A node with more edges than one task takes is dealt out, and gives the same pairs."""
    e = spark.createDataFrame([(f"s{i}", f"p{i % 3 if i % 2 else 0}") for i in range(40)], "from_id string, to_id string")
    rows = lambda df: sorted((r["from_id"], r["to_id"], r["evidence"]) for r in df.collect())
    assert rows(graph.derived_edges(e, e, most=3)) == rows(graph.derived_edges(e, e)) and graph.derived_edges(e, e, most=3).count() > 500


def test_derived_edges_are_counted_before_they_are_moved(spark, monkeypatch):
    """One table or two, repeated edges, nulls and hot nodes, few pairs at once: the counts are those of all pairs, and no pair is made by a join."""
    some = [(f"s{i * i % 23}", f"p{i % 5 if i % 3 else 0}") for i in range(90)] + [(None, "p1"), ("s1", None)]
    e, same = (spark.createDataFrame(some, "from_id string, to_id string") for _ in range(2))
    f = spark.createDataFrame([(f"s{i % 9}", f"p{i % 4}") for i in range(30)], "from_id string, to_id string")
    edges = lambda df: {(r["from_id"], r["to_id"]) for r in df.collect() if r["from_id"] and r["to_id"]}
    for one, two in ((e, e), (e, same), (e, f), (f, e)):
        want = Counter((a, b) for a, x in edges(one) for b, y in edges(two) if x == y and a != b)
        for most, pairs in ((1000, 4_000_000), (4, 10)):
            monkeypatch.setattr(graph, "PAIRS", pairs)
            got = graph.derived_edges(one, two, most=most).collect()
            assert len(got) == len(want) and {(r["from_id"], r["to_id"]): r["evidence"] for r in got} == want
    assert "Join" not in graph.derived_edges(f, f)._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "")


def test_events_without_a_repository(spark):
    """They belong to no window of a repository, and to no edge."""
    some = [envelope(1, "CommitAnalyzed", 1, sha="a", authorEmail="m@x.org"), envelope(2, "CommitAnalyzed", 2, sha="b"), envelope(3, "RepositoryDeleted", 3)]
    e = E.parse(spark.createDataFrame([(json.dumps(x),) for x in some], "value string"))[0]
    assert {r["node_id"] for r in graph.fold_nodes(e).collect()} == {"commit:a", "commit:b", "developer:m@x.org"}
    assert {(r["from_id"], r["type"]) for r in graph.fold_edges(e).collect()} == {("developer:m@x.org", "AUTHORED_BY")}


def test_commits_and_payloads(log, spark):
    raw = spark.createDataFrame([("r", f"s{i}", "a@x.org", "m" * 600, ["f"] * 60, 1000 + i) for i in range(5)], "repository_id string, sha string, author_email string, message string, files array<string>, committed long")
    got = folds.commits(raw, per_repository=2).collect()
    assert {r["sha"] for r in got} == {"s3", "s4"} and {(len(r["message"]), len(r["files_changed"])) for r in got} == {(500, 50)} and min(r["committed_at"] for r in got).second == 43
    p = E.payloads(log, "DependencyDetected", 1).first()
    assert (p["name"], p["version"], p["sourceFile"]) == ("requests", "2.31.0", "requirements.txt") and E.payloads(log, "DependencyDetected", 2).count() == 0
    assert [r["eventId"] for r in E.recent(log, 5, topic="document.processed").collect()] == ["e005", "e004"] and E.recent(log, 5, topic="nothing").count() == 0
    late = log.withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 day")).withColumn("payload", F.lit("late"))
    assert {r["payload"] == "late" for r in E.deduplicate(late.union(log)).collect()} == {False}


def test_catalog_against_the_router():
    """Where the list of topics names consumers that follow nothing of the kind, and consumers it does not name."""
    from lodestone.sources.schemas import TOPICS

    services = {"document-service": "documents", "embedding-service": "embeddings", "graph-service": "graph", "search-service": "search"}
    drift = {(kind, s) for _, kind, _, consumers in TOPICS for s in services if (s in consumers) != (kind in jobs.SUBSCRIPTIONS[services[s]])}
    assert drift == {("RepositoryCreated", "embedding-service"), ("EmbeddingGenerated", "search-service")}


def test_projection_by_key(spark, log, tmp_path):
    """Batch by batch, only the repositories of a batch are folded again; the last snapshot is the fold of the whole log."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    folded = []

    def fold(events):
        folded.append(events.count())
        return folds.repositories(events)

    good = log.filter("eventId not in ('e009', 'e010')")
    for n, some in enumerate((good.filter("eventId <= 'e006'"), good.filter("eventId > 'e006' and eventId < 'e015'"), good.filter("eventId >= 'e015'"))):
        some.coalesce(1).write.mode("append").json(str(src))
        q = jobs.project(jobs.read_events(spark, str(src)), str(tmp_path / "log"), fold, out, str(tmp_path / "c"), key=("repositoryId", "repository_id"))
        q.awaitTermination()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.read.parquet(f"{out}/batch=2")) == rows(folds.repositories(good)) and folded[-1] < good.count()


def test_search_fold(log):
    s = {r["id"]: r["text"] for r in folds.search_documents(log).collect()}
    assert s["r1"] == "payment-gateway Go https://x.org/1 public main" and s["r2"] == "other https://x.org/1" and "r4" not in s
    assert s["d1"] == "kubernetes autoscaling ingress" and s["d0"] == "openapi-spec TEXT r1" and s["commit:abc"] == "feat: implement circuit breaker pattern A a@x.org"


def test_repositories(log):
    r = {x["repository_id"]: x for x in folds.repositories(log).collect()}
    assert set(r) == {"r1", "r5"} and r["r1"]["visibility"] == "public" and r["r5"]["name"] == "new" and r["r1"]["default_branch"] == "main"
    before = folds.repositories(log.filter("eventId < 'e002'"))
    assert folds.changed_fields(before, folds.repositories(log)).first()["changes"] == ["visibility"]
    docs = folds.readmes(log)
    assert {x["repository_id"] for x in docs.collect()} == {"r1", "r2", "r3", "r5"} and folds.chunk_rows(docs).count() == 4


def test_log_order_and_retry(log, spark):
    assert [r["eventId"] for r in E.recent(log, 3).collect()] == ["e016", "e015", "e014"]
    assert E.recent(log, 10, "CommitAnalyzed", log=3).count() == 0
    assert E.deduplicate(log.union(log)).count() == len(LOG)
    again, dead = E.retry(spark.createDataFrame([("a", 0), ("b", 3), ("c", 4)], "eventId string, attempt int").withColumn("failed_at", F.to_timestamp(F.lit("2024-01-01 00:00:00"))))
    assert {r["eventId"]: r["retry_at"].minute for r in again.collect()} == {"a": 0, "b": 10} and [r["eventId"] for r in dead.collect()] == ["c"]
    assert {r["status"] for r in E.health(spark.createDataFrame([("ok",), ("down",)], "status string")).collect()} == {"degraded"}
    assert E.with_topic(log, E.topics(spark)).filter("topic = 'repository.created'").count() == 6
    made = E.make(spark.range(1), "X", F.struct("id"), F.col("id"), F.to_timestamp(F.lit("2024-01-01")))
    assert made.first()["eventId"] == made.first()["eventId"] and len(made.first()["eventId"]) == 36


def test_rate_limit(spark):
    times = [0, 1, 2, 3, 30, 59.5, 60, 61, 62, 200, 200, 200, 200]
    rows = [("c", i, float(t)) for i, t in enumerate(times)] + [("d", 100, 0.0)]
    df = spark.createDataFrame(rows, "client string, request_id long, t double").withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    held, want = [], {}
    for i, t in enumerate(times):
        held = [h for h in held if h > t - 60]
        want[i] = len(held) < 3
        held += [t] * want[i]
    got = {r["request_id"]: r["admitted"] for r in E.rate_limit(df, 3, 60.0).collect()}
    assert got == want | {100: True}


def test_streams(spark, log, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.coalesce(1).write.json(src)
    stream = jobs.read_events(spark, src)
    q = jobs.project(stream, str(tmp_path / "log"), graph.fold_nodes, out, str(tmp_path / "c1"), jobs.SUBSCRIPTIONS["graph"])
    q.awaitTermination()
    got = {r["node_id"]: r["props"] for r in spark.read.parquet(f"{out}/batch=0").collect()}
    assert got == {r["node_id"]: r["props"] for r in graph.fold_nodes(log).collect()}
    q = jobs.rates(jobs.once(jobs.read_events(spark, src)), late=None).writeStream.format("memory").queryName("rates_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    requests = jobs.read_events(spark, src).select(F.lit("c").alias("client"), F.col("eventId").alias("request_id"), "timestamp")
    q = jobs.rate_limit(requests, 5, 3600.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count_if(admitted) n from limited").first()["n"] == 5
    assert ENVELOPE.startswith("eventType") and set(jobs.SUBSCRIPTIONS) == {"documents", "embeddings", "graph", "search", "analyzer", "log"}
