"""Durable keyed tables: whole versions, writers that die or meet, rows of one key, cascades."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import stores, vectors
from lodestone.sources.keyed import Delete, Keyed, Merge, Store, add, patch, upsert
from lodestone.sources.versions import Versions

ROWS = "k long, name string, n int"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"t": Keyed(ROWS, ("k",), buckets=8), "u": Keyed("a string, b int, x map<string,string>", ("a", "b"), ("a",), 4)})


def content(store, table="t", version=None):
    return {r["k"]: (r["name"], r["n"]) for r in store.read(table, version).collect()}


def frame(spark, *rows, schema=ROWS):
    return spark.createDataFrame(list(rows), schema)


def test_merge_kinds(spark, store):
    assert content(store) == {}
    store.apply(upsert("t", frame(spark, *[(i, f"a{i}", i) for i in range(30)])))
    store.apply(upsert("t", frame(spark, (1, "new", None), (50, "more", 5), (None, "no key", 1))))
    assert content(store)[1] == ("new", None) and content(store)[50] == ("more", 5) and len(content(store)) == 31
    store.apply(patch("t", frame(spark, (1, None, 7), (2, "patched", None), (99, "absent", 1))))
    assert content(store)[1] == ("new", 7) and content(store)[2] == ("patched", 2) and 99 not in content(store)
    store.apply(upsert("t", spark.createDataFrame([(3, 33), (60, 6)], "k long, n int")))
    assert content(store)[3] == ("a3", 33) and content(store)[60] == (None, 6)
    store.apply(add("t", frame(spark, (1, "late", 1), (70, "added", 1))))
    assert content(store)[1] == ("new", 7) and content(store)[70] == ("added", 1)
    store.apply(Merge("t", frame(spark, (1, "z", 3)), {"n": lambda old, new: old + new}))
    assert content(store)[1] == ("z", 10)
    store.apply(Delete("t", spark.createDataFrame([(1,), (2,), (12345,)], "k long")))
    assert len(content(store)) == 31 and content(store, version=1)[1] == ("a1", 1)
    assert [tuple(r) for r in store.get("t", k=3).collect()] == [(3, "a3", 33)] and store.get("t", k=1).count() == 0
    store.apply(Delete("t", store.read("t").select("k")))
    assert content(store) == {}


def test_repeated_keys_have_a_winner(spark, store):
    store.apply(upsert("t", frame(spark, (1, "x", 1), (1, "y", 3), (1, "w", 2)).repartition(3), order=("n",)))
    assert content(store) == {1: ("y", 3)}
    first = None
    for _ in range(3):  # without an order always the same one
        store.apply(upsert("t", frame(spark, *[(2, f"v{i}", i) for i in range(20)]).repartition(4)))
        first = first or content(store)[2]
        assert content(store)[2] == first
    store.apply(upsert("u", spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 1, {"x": "1"}), ("a", 2, None)], "a string, b int, x map<string,string>")))
    assert store.get("u", a="a").count() == 2


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_writer_that_dies_changes_nothing(spark, store, monkeypatch, step):
    store.apply(upsert("t", frame(spark, *[(i, "old", i) for i in range(20)])))

    def die(*a, **k):
        raise OSError("killed")

    with monkeypatch.context() as m:
        if step == "write":
            whole = store._write
            m.setattr(store, "_write", lambda table, *a: whole(table, *a) if table == "t" else die())  # one of two tables is written
        else:
            m.setattr(Versions, "commit", die)
        with pytest.raises(OSError):
            store.apply(upsert("t", frame(spark, (1, "half", 1))), upsert("u", spark.createDataFrame([("a", 1)], "a string, b int")))
    assert content(store)[1] == ("old", 1) and store.read("u").count() == 0
    store.apply(Delete("t", spark.createDataFrame([(2,)], "k long")))
    assert content(store) == {i: ("old", i) for i in range(20) if i != 2}
    left = len(store.versions.names("data"))
    assert store.vacuum(keep=1, older_than=0.0) >= 1 and len(store.versions.names("data")) < left
    assert content(store) == {i: ("old", i) for i in range(20) if i != 2} and store.versions.numbers() == [2]


def test_writers_that_meet(spark, tmp_path):
    open_ = lambda: Store(spark, str(tmp_path / "store"), {"t": Keyed(ROWS, ("k",), buckets=4)})
    open_().apply(upsert("t", frame(spark, *[(i, "old", 0) for i in range(10)])))
    errors = []

    def work(who):
        try:
            for i in range(3):
                open_().apply(upsert("t", frame(spark, (100 * who + i, f"w{who}", i))), Merge("t", frame(spark, (0, None, 1)), {"n": lambda old, new: old + new, "name": lambda old, new: old}))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = content(open_())
    assert {k for k in got if k >= 100} == {100 * w + i for w in (1, 2, 3) for i in range(3)} and got[0] == ("old", 9) and len(got) == 19


def test_a_number_is_taken_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.newest() == (0, {}) and v.commit(1, {"a": 1}) and not v.commit(1, {"a": 2}) and v.newest() == (1, {"a": 1})


def test_only_touched_buckets_are_written(spark, store):
    store.apply(upsert("t", frame(spark, *[(i, "x", i) for i in range(100)])))
    before = store.versions.newest()[1]["tables"]["t"]
    store.apply(upsert("t", frame(spark, (5, "y", 5))))
    after = store.versions.newest()[1]["tables"]["t"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1


def test_documents_and_chunks(spark, tmp_path):
    d = stores.Documents(spark, str(tmp_path / "d"), 4)
    files = lambda *rows: spark.createDataFrame(list(rows), "document_id string, repository_id string, file_name string, content string")
    d.put(files(("a", "r1", "a.md", "# one " + "w " * 1000), ("b", "r1", "b.txt", "short"), ("c", "r2", "c.txt", "")))
    assert {(r["document_id"], r["chunk_index"]) for r in d.read("chunks").collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    d.put(files(("a", "r1", "a.md", "few words"),))
    assert {(r["document_id"], r["content"]) for r in d.read("chunks").collect()} == {("a", "few words"), ("b", "short")}
    d.delete_repositories(spark.createDataFrame([("r1",)], "repository_id string"))
    assert [r["document_id"] for r in d.read("documents").collect()] == ["c"] and d.read("chunks").count() == 0


def test_graph(spark, tmp_path):
    g = stores.Graph(spark, str(tmp_path / "g"), 4)
    t = [datetime.datetime(2024, 1, i) for i in (1, 2, 3)]
    node = "node_id string, label string, props map<string,string>, created_at timestamp, updated_at timestamp"
    g.merge_nodes(spark.createDataFrame([("a", "X", {"p": "1", "q": "2"}, t[1], t[1]), ("b", "X", None, t[0], t[0])], node))
    g.merge_nodes(spark.createDataFrame([("a", "Y", {"p": None, "q": "3", "r": "4"}, t[0], t[2])], node))
    a = g.get("nodes", node_id="a").first()
    assert a["props"] == {"p": "1", "q": "3", "r": "4"} and a["label"] == "X" and a["created_at"] == t[0] and a["updated_at"] == t[2]
    edge = "from_id string, to_id string, type string, created_at timestamp"
    g.merge_edges(spark.createDataFrame([("a", "b", "USES", t[1]), ("b", "a", "USES", t[1]), ("a", "zz", "USES", t[0])], edge))
    g.merge_edges(spark.createDataFrame([("a", "b", "USES", t[0]), ("a", "b", "USES", t[2])], edge))
    assert {(r["from_id"], r["to_id"], r["created_at"]) for r in g.read("edges").collect()} == {("a", "b", t[0]), ("b", "a", t[1])}
    g.detach_delete(spark.createDataFrame([("b",)], "node_id string"))
    assert g.read("edges").count() == 0 and [r["node_id"] for r in g.read("nodes").collect()] == ["a"]


def test_repositories(spark, tmp_path):
    r = stores.Repositories(spark, str(tmp_path / "r"), 4)
    row = "repository_id string, url string, name string, created_at timestamp"
    day = lambda i: datetime.datetime(2024, 1, i)
    r.insert(spark.createDataFrame([("b", "https://x/1", "late", day(2)), ("a", "https://x/1", "first", day(1)), ("c", "not a url", "bad", day(1))], row))
    r.insert(spark.createDataFrame([("d", "https://x/1", "taken", day(1)), ("a", "https://x/2", "id taken", day(1))], row))
    assert [(x["repository_id"], x["name"]) for x in r.read("repositories").collect()] == [("a", "first")]
    r.delete(spark.createDataFrame([("a",)], "repository_id string"))
    r.insert(spark.createDataFrame([("d", "https://x/1", "free now", day(1))], row))
    assert [(x["repository_id"], x["name"]) for x in r.read("repositories").collect()] == [("d", "free now")]


def test_vectors_with_ids_of_any_kind(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]
    named = spark.createDataFrame([(f"n{i}", x) for i, x in enumerate(v)], "id string, vector array<double>")
    got = vectors.top_similar_many(named, named.withColumnRenamed("id", "query_id"), 2).collect()
    assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "n0"] == [("n1", 1.0), ("n3", 0.707107)]
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "n2"] == ["n3", "n0"] and not [r for r in got if r["query_id"] == "n4"]
    both = named.select(F.struct(F.col("id").alias("document_id"), F.lit(1).alias("chunk_index")).alias("id"), "vector")
    got = vectors.top_similar_many(both, named.select(F.col("id").alias("query_id"), "vector"), 1).collect()
    assert {r["query_id"]: r["id"]["document_id"] for r in got} == {"n0": "n0", "n1": "n0", "n2": "n2", "n3": "n3"}
    same = vectors.top_similar_many(both, both.withColumnRenamed("id", "query_id"), 1).collect()
    assert {r["query_id"]["document_id"]: r["id"]["document_id"] for r in same} == {"n0": "n1", "n1": "n0", "n2": "n3", "n3": "n0"}
