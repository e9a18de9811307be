"""What goes wrong only on larger tables, with the keys or the counts of larger ones in small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lodestone.catalog import ORACLE_SQL, QUERIES
from lodestone.functions import similarity as S
from lodestone.llm import lexical
from lodestone.operators import histories, index
from lodestone.sources.store import stored


@pytest.fixture(scope="module")
def far(spark, sf, tmp_path_factory):
    """The smallest tables with keys as great as those of far larger ones."""
    out = str(tmp_path_factory.mktemp("far"))
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        far_ = {"customer": "c_custkey + 6000000 AS c_custkey", "orders": "case when o_orderkey % 2 = 0 then o_orderkey + 300000000 else o_orderkey end AS o_orderkey, o_custkey + 6000000 AS o_custkey", "part": "p_partkey + 6000000 AS p_partkey", "documents": "doc_id + 6000000 AS doc_id"}.get(t)
        con.execute(f"copy (select * {f'replace ({far_})' if far_ else ''} from '{sf}/{t}.parquet') to '{out}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{out}/{t}.parquet'")
    return out, con


@pytest.mark.parametrize("name", ["event_fold_edges", "graph_update_counts", "search_fold", "repository_state"])
def test_events_keep_their_order_whatever_the_keys(name, spark, far):
    folder, con = far
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect())
    assert got and got == sorted(tuple(map(str, r)) for r in con.execute(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall())


def test_events_keep_their_order_beyond_the_year_9999(spark, sf, tmp_path):
    """Keys so great that commits, parts and documents come later than any year of four digits, and customers are more than the microseconds of a day."""
    con = duckdb.connect()
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "part": ["p_partkey"], "documents": ["doc_id"]}
    for t, own in keys.items():
        con.execute(f"copy (select * replace ({', '.join(f'{k} + 300000000000 AS {k}' for k in own)}) from '{sf}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = sorted(map(tuple, QUERIES["graph_update_counts"](spark, str(tmp_path)).select("trigger_event", "events", "nodes", "relationships").collect()))
    assert got == sorted(con.execute(f"select trigger_event, events, nodes, relationships from ({ORACLE_SQL['graph_update_counts']})").fetchall())


def test_histories_are_not_broadcast_by_the_size_of_their_files(spark):
    h = spark.range(100).select((F.col("id") % 10).alias("k"), F.timestamp_seconds("id").alias("valid_from"), F.timestamp_seconds(F.col("id") + 20).alias("valid_to"), F.col("id").alias("v"))
    met = histories.overlaps(h, h.withColumnRenamed("v", "w"), ["k"])
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 280  # each of ten keys: every version with itself, and with the one before and the one after it


def test_stub_vectors_to_the_last_bit(spark):
    """Texts whose squares sum to a square, so that every value times 100,000 is a half: what it is rounded to shows the last bit of the length."""
    import hashlib

    def digest_sum(t):
        return sum((2 * b - 255) ** 2 for b in hashlib.sha256(t.encode()).digest())

    texts = [t for t in (f"web de {i}" for i in range(400_000)) if digest_sum(t) in (640_000, 736**2, 864**2, 928**2)]
    assert texts
    con = duckdb.connect()
    con.execute("create table t as select unnest(?) as text", [texts])
    sql = """with h as (select text, sha256(text) as h from t), r as (select text, list_transform(range(0, 128), lambda i: ('0x' || substr(h, 2 * (i % 32) + 1, 2))::INT / 255.0::DOUBLE * 2 - 1) as r from h),
    n as (select text, r, sqrt(list_dot_product(r, r)) as n from r) select text, list_transform(r, lambda x: x / n) from n"""
    want = dict(con.execute(sql).fetchall())
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.stub_embedding(F.col("text")).alias("v")).collect()
    assert all(list(r["v"]) == list(want[r["text"]]) for r in rows)


def test_shards_are_written_as_they_come(spark, monkeypatch):
    """Rows of megabytes must not wait for the hundredth."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical, "GROUP", 1024)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 + j}" for j in range(60))) for i in range(40)], "doc_id long, text string").coalesce(1)
    own = lexical.build(docs, postings=100)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(own.shards._lodestone_path.removeprefix("file:") + "/*.parquet")]
    assert sum(f.num_rows for f in files) == 20 and max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 3


def test_documents_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "t", "b a, B c"), (2, "t", None), (3, "t", "\u0130x a-a"), (4, None, "")], "id long, type string, text string")
    counted = index._counted(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["id"], w["token"], w["n"], tuple(w["positions"])) for r in counted.collect() for w in r["words"])
    assert got == sorted((r["id"], r["token"], r["n"], tuple(r["positions"])) for r in index.postings(docs).collect())


def test_only_rare_tokens_are_shuffled_beyond_a_broadcast(spark, monkeypatch, tmp_path):
    """A vocabulary too great to be broadcast: its frequent tokens still are, and all frequencies are right."""
    want = {f"t{i}": 1 + i % 9 for i in range(200)}
    spark.createDataFrame(list(want.items()), "token string, df long").write.parquet(str(tmp_path / "terms"))
    terms, rows = spark.read.parquet(str(tmp_path / "terms")), spark.createDataFrame([(t,) for t in want] * 2, "token string")
    for ids in (1_000_000, 70, 0):
        monkeypatch.setattr(index, "IDS", ids)
        got = index._frequencies(terms)(rows)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() or not ids
        got = got.collect()
        assert len(got) == 400 and {r["token"]: r["df"] for r in got} == want


def test_wide_rows_are_not_moved_to_meet_their_ids(spark, monkeypatch):
    """Beyond a broadcast, ranges of ids are broadcast one after the other; every row still meets its id once."""
    ids = stored(spark.createDataFrame([(i * 3, i) for i in range(100)], "id long, v int"), "ids")
    rows = spark.createDataFrame([(i % 310,) for i in range(620)], "id long")
    for most in (1000, 30, 1):
        monkeypatch.setattr(index, "IDS", most)
        got = index._by_id(ids)(rows)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted((i * 3, i) for i in range(100) for _ in range(2))


def test_postings_are_moved_by_parts(spark, monkeypatch, tmp_path):
    """Packed by part and unpacked, no row is lost or changed; parts follow each other in the order of token and block, and a frequent token is cut."""
    rows = [(f"t{i % 7}", i, i % 4, [i, i + 1]) for i in range(300)] + [("t9", i, i % 4, []) for i in range(200)]
    posts = spark.createDataFrame(rows, "token string, id long, block int, positions array<int>").repartition(3)
    posts.groupBy("token").agg(F.count("*").alias("df")).coalesce(1).sortWithinPartitions("token").write.parquet(str(tmp_path / "terms"))
    monkeypatch.setattr(index, "POSTINGS", 50)
    terms = spark.read.parquet(str(tmp_path / "terms"))
    cuts = index._cuts(terms, 60)
    assert ("t9", 0.25) in cuts and ("t9", 0.75) in cuts and len(cuts) >= 6
    got = index._moved(posts, terms, 4, 60)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    parts = [sorted((r["token"], r["block"]) for r in own) for own in got.rdd.glom().collect() if own]
    spread = {p[0][0] for p in parts} | {p[-1][0] for p in parts}
    assert len(parts) > 2 and len(spread) > 2 and sum(any(t == "t9" for t, _ in p) for p in parts) > 1


def test_what_follows_from_ids_and_tokens_is_moved_once_for_each(spark, monkeypatch, tmp_path):
    """Ids of any kind, no positions, long lists and negative steps come back as they were; what a posting takes does not grow with the columns of its document."""
    rows = [(f"d{d:03d}", f"t{t}", [5 * d + i * (t - 2) for i in range(t)], d % 4, f"type {d % 3}", 1 / (d + 3), 40) for d in range(400) for t in range(7)]
    posts = spark.createDataFrame(rows, "id string, token string, positions array<int>, block int, type_ string, norm double, df int").repartition(2)
    terms = posts.groupBy("token").agg(F.count("*").alias("df")).coalesce(1).sortWithinPartitions("token")
    alike = ("block", "type_", "norm"), ("df",)
    for held in (1_000_000, 100):
        monkeypatch.setattr(index, "POSTINGS", held)
        got = index._moved(posts, terms, 4, 500, *alike)
        assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
        parts = [p for p in got.rdd.glom().collect() if p]
        assert len(parts) > 4 and max(len(p) for p in parts) <= 900  # a part each: 500, and a token that is not cut
    few, many = (index._packed(posts.select(*c), index._cuts(terms, 5000), 4, *own).agg(F.sum(F.length("rows"))).first()[0] for c, own in ((("id", "token", "positions", "block"), ()), (posts.columns, alike)))
    assert many < 2 * few + 8 * 400 * 2


def test_bounds_are_few_values_and_hold(spark, tmp_path):
    """The greatest impacts of tokens and blocks are rounded up, a little and to few values, so that they take little room."""
    own = index.Store(spark, str(tmp_path)).add(spark.createDataFrame([(i, "t", " ".join(f"w{i * j % 997}" for j in range(1, 3 + i % 50))) for i in range(600)], "id long, type string, text string")).tables()
    most = own.postings.groupBy("token", "block").agg(F.max("impact").alias("exact")).join(own.bounds, ["token", "block"])
    n, low, high, kinds = most.agg(F.count("*"), F.min(F.col("most") / F.col("exact")), F.max(F.col("most") / F.col("exact")), F.max(F.col("most") * (1 << 20) % 1)).first()
    assert n == own.bounds.count() > 1000 and 1 <= low and high <= 1.002 and kinds == 0


def test_entries_in_runs_are_written_where_they_are(spark, monkeypatch, tmp_path):
    """Files of some runs of ids each, as tasks write them that read some files of an ordered table, are sorted but not moved; ids scattered over the files are moved."""
    store, by = index.Store(spark, str(tmp_path)), DataFrame.repartitionByRange
    for name, file in (("runs", "int(id / 1750) % 4"), ("scattered", "int(id % 4)")):
        own = stored(spark.range(14_000).repartitionById(4, F.expr(file)).select("id"), "own")
        moved = []
        monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *a: moved.append(a) or by(df, *a))
        store._write_entries(own, name)
        monkeypatch.setattr(DataFrame, "repartitionByRange", by)
        assert moved == ([] if name == "runs" else [("id",)])
        files = store._read(name, "entries").select("id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("f", "at").collect()
        assert sorted(r["id"] for r in files) == list(range(14_000)) and all(a["id"] < b["id"] for a, b in zip(files, files[1:]) if a["f"] == b["f"])


def test_entries_in_order_are_written_where_they_are(spark, monkeypatch, tmp_path):
    """Documents that come in the order of their ids are not moved for it, others are; either way an index finds the same."""
    docs = [(i, "t", f"w{i % 5} w{i % 11} x") for i in range(60)]
    monkeypatch.setattr(index, "POSTINGS", 20)
    kept = []
    for at, (ids, order) in enumerate([(1_000_000, "id"), (1_000_000, "-id % 7"), (7, "id")]):
        monkeypatch.setattr(index, "IDS", ids)
        moved, by = [], DataFrame.repartitionByRange
        monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *a, by=by: moved.append(a) or by(df, *a))
        own = spark.createDataFrame(docs, "id long, type string, text string").repartitionByRange(3, F.expr(order))
        moved.clear()
        store = index.Store(spark, str(tmp_path / str(at))).add(own, "2024-01-01 00:00:00")
        monkeypatch.setattr(DataFrame, "repartitionByRange", by)
        assert (("id",) in moved) == (order != "id")
        t = store.tables()
        kept.append((sorted((r["id"], round(r["norm"], 12), r["block"]) for r in t.entries.collect()), sorted((r["token"], r["id"], r["n"], r["tf"], round(r["impact"], 12)) for r in t.postings.collect())))
    assert kept[0] == kept[1] == kept[2] and len(kept[0][0]) == 60


def test_more_documents_than_the_driver_holds_are_met_by_a_shuffle(spark, monkeypatch, tmp_path):
    """Broadcast range by range, all ranges of a table lie in the driver at once; beyond a bound none is, and the index is the same."""
    docs, broadcast = spark.createDataFrame([(f"d{i % 60}", "t", f"w{i % 5} w{i % 11} x") for i in range(0, 420, 7)], "id string, type string, text string"), []
    monkeypatch.setattr(index, "IDS", 7)
    by, kept = index._by_id, []
    monkeypatch.setattr(index, "_by_id", lambda t: broadcast.append(t) or by(t))
    for most in (400, 100):
        monkeypatch.setattr(index, "HELD", most)
        store = index.Store(spark, str(tmp_path / str(most))).add(docs, "2024-01-01 00:00:00")
        ranges = len(broadcast)
        assert ranges == (1 if most == 400 else 0)
        store.add(docs.filter("id < 'd3'").withColumn("text", F.lit("w1 new"))).merge()
        broadcast.clear()
        t = store.tables()
        files = t.entries.select("id", F.input_file_name().alias("f")).groupBy("f").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
        assert all(a["high"] < b["low"] for a, b in zip(files, files[1:]))
        kept.append((sorted((r["id"], round(r["norm"], 12), r["block"]) for r in t.entries.collect()), sorted((r["token"], r["id"], r["n"], r["tf"], round(r["impact"], 12)) for r in t.postings.collect())))
    assert kept[0] == kept[1] and len(kept[0][0]) == 60
