"""Golden values and behaviour: search, text, similarity, vectors, manifests."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import manifests
from lodestone.functions import similarity as S
from lodestone.functions import text as T
from lodestone.operators import index, listing, search, vectors
from lodestone.plans.graphing import MANIFESTS

CORPUS = [
    ("repo_001", "Repository", "payment service golang microservice billing"), ("repo_002", "Repository", "invoice management python backend"),
    ("repo_003", "Repository", "payment gateway java spring billing"), ("doc_001", "Document", "README payment service documentation"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "id string, type string, text string").cache()


def found(df):
    return [(r["id"], r["tfidf"], r["score"], r["match_type"]) for r in df.orderBy(F.desc("score"), "id").collect()]


@pytest.mark.parametrize(
    ("query", "fuzzy", "want"),
    [
        ("billing", False, [("repo_001", 0.406192, 0.656192, "exact"), ("repo_003", 0.38377, 0.63377, "exact")]),
        ("payment", False, [("doc_001", 0.345205, 0.595205, "exact"), ("repo_001", 0.315444, 0.565444, "exact"), ("repo_003", 0.298032, 0.548032, "exact")]),
        ("payment billing", False, [("repo_001", 0.514292, 0.764292, "exact"), ("repo_003", 0.485903, 0.735903, "exact"), ("doc_001", 0.211733, 0.461733, "exact")]),
        ("pay", False, [("doc_001", 0.0, 0.15, "prefix"), ("repo_001", 0.0, 0.15, "prefix"), ("repo_003", 0.0, 0.15, "prefix")]),
        ("paymnt", True, [(i, 0.0, -0.1, "fuzzy(editDistance=1)") for i in ("doc_001", "repo_001", "repo_003")]),
        ("   ", True, []), ("xyzzy12345", True, []),
    ],
)
def test_search(corpus, query, fuzzy, want):
    assert found(search.search(corpus, query, fuzzy=fuzzy)) == want


def test_search_options(corpus, spark):
    assert {r["type"] for r in search.search(corpus, "payment", type="Document").collect()} == {"Document"}
    assert search.search(corpus, "payment", 2).count() == 2
    again = index.add(corpus, spark.createDataFrame([("repo_002", "Repository", "payment")], corpus.schema))
    assert again.count() == 4 and "repo_002" in {r["id"] for r in search.search(again, "payment", fuzzy=False).collect()}
    assert index.remove(corpus, spark.createDataFrame([("doc_001",)], "id string")).count() == 3
    for bad in ({"top_k": 0}, {"top_k": 101}, {"max_distance": 5}):
        with pytest.raises(ValueError):
            search.search(corpus, "x", **bad)
    plan = search.search_many(corpus, corpus.select(F.col("id").alias("query_id"), "text"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_suggest_explain_stats(corpus, spark, tmp_path):
    w = index.idf(index.postings(corpus), index.corpus_size(corpus))
    assert [r["token"] for r in search.suggest(w, "pay").collect()] == ["payment"] and search.suggest(w, "zzz").count() == 0
    e = {r["query_token"]: r for r in search.explain(corpus, "payment pay").collect()}
    assert e["payment"]["idf"] == 1.0 and e["payment"]["document_frequency"] == 3 and e["pay"]["prefix_matches"] == 3 and e["pay"]["idf"] == 0
    t = search.explain_totals(corpus, 2).first()
    assert (t["documents"], t["vocabulary"], t["top_terms"]) == (4, 14, "backend documentation")


def test_stored_index(corpus, spark, tmp_path):
    """Added, added again, removed: searches see the newest texts only, and another reader of the folder sees the same."""
    store = index.Store(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        store.tables()
    meta = corpus.withColumn("metadata", F.create_map(F.lit("owner"), F.lit("x")))
    store.add(meta, "2024-01-01 00:00:00")
    for q in ("payment billing", "pay", "paymnt"):
        assert found(search.search(store.tables(), q)) == found(search.search(corpus, q))
    row = search.search(store.tables(), "billing").first()
    assert (row["metadata"], row["token_count"], row["unique_tokens"], row["indexed_at"].year) == ({"owner": "x"}, 5, 5, 2024)
    new = spark.createDataFrame([("repo_002", "Repository", "payment ledger")], corpus.schema)
    store.add(new).remove(spark.createDataFrame([("doc_001",), ("nobody",)], "id string"))
    s = index.Store(spark, str(tmp_path / "index")).stats().first()
    assert (s["documents"], s["total_indexed"], s["total_removed"]) == (3, 5, 1)
    now = corpus.filter("id not in ('repo_002', 'doc_001')").union(new)
    for q in ("payment billing", "pay", "invoice", "readme", "ledger"):
        assert found(search.search(store.tables(), q)) == found(search.search(now, q))
    assert [r["id"] for r in search.similar(store.tables(), "repo_002", 2).collect()] == [r["id"] for r in search.similar(now, "repo_002", 2).collect()]
    store.add(spark.createDataFrame([("doc_001", "Document", "back again")], corpus.schema))
    assert [r["id"] for r in search.search(store.tables(), "again", fuzzy=False).collect()] == ["doc_001"]
    assert [r["id"] for r in search.phrase(corpus, "Payment-service golang").collect()] == ["repo_001"] and search.phrase(corpus, " ").count() == 0


def test_long_tokens_are_not_taken_apart(spark):
    """A token of 60,000 characters costs a prefix for each length asked for, not for each of its own."""
    corpus = spark.createDataFrame([(1, "t", "x" * 60_000 + " pay"), (2, "t", "payment")], "id long, type string, text string")
    got = search.search_many(corpus, spark.createDataFrame([(9, "pay xx")], "query_id long, text string")).collect()
    assert {(r["id"], r["match_type"]) for r in got} == {(1, "exact"), (2, "prefix")}
    words = spark.createDataFrame([("pey",)], "token string")
    assert [r["b"] for r in search.fuzzy_pairs(words, index.postings(corpus).select("token").distinct(), 1).collect()] == ["pay"]


def test_levenshtein_and_fuzzy(spark):
    pairs = [("payment", "payment", 0), ("", "abc", 3), ("paymnt", "payment", 1), ("ab", "ba", 2), ("kitten", "sitting", 3), ("saturday", "sunday", 3), ("a", "abcdefgh", None)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert all(r["d"] == r["got"] for r in df.withColumn("got", S.edit_distance(F.col("a"), F.col("b"), 4)).collect())
    v = spark.createDataFrame([("payment",), ("pay",), ("payroll",)], "token string")
    assert [r["token"] for r in search.fuzzy_match(v, "pay", 5).collect()] == ["pay", "payment", "payroll"]
    got = {(r["a"], r["b"]) for r in search.fuzzy_pairs(spark.createDataFrame([("paymnt",), ("pey",)], "token string"), v, 1).collect()}
    assert got == {("paymnt", "payment"), ("pey", "pay")}


def test_jaro(spark):
    assert round(S.jaro_winkler("payment", "paymnet"), 6) == 0.971429 and round(S.jaro_winkler("search", "seach"), 6) == 0.961111
    assert round(S.jaro("xxabcxx", "xxbcaxx"), 6) == 0.928571 and S.jaro_winkler("", "") == 1 and S.jaro_winkler("payment", "") == 0
    r = spark.createDataFrame([("payment", "paymnet"), (None, "a")], "a string, b string").select(S.jaro_winkler_similarity("a", "b").alias("j")).collect()
    assert round(r[0]["j"], 6) == 0.971429 and r[1]["j"] is None


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_bounds(a, b):
    assert 0 <= S.jaro(a, b) <= 1 and S.jaro(a, a) == 1 and S.jaro(a, b) <= S.jaro_winkler(a, b) <= 1


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.tokenize(t), t="Héllo, World-9") == ["h", "llo", "world", "9"]
    assert one(spark, T.strip_markdown(t), t="a **b** c_d *e*") == "a b cd *e*" and one(spark, T.strip_markdown(t), t="[label](http://x)") == "label"
    assert one(spark, T.strip_markdown(t), t="x `code` y") == "x  y" and one(spark, T.strip_html(t), t="<p>a</p><p>b</p>") == " a  b "
    for name, kind in (("notes.MD", "MARKDOWN"), ("a.markdown", "MARKDOWN"), ("a.html", "HTML"), ("a.txt", "TEXT"), ("Makefile", "TEXT")):
        assert one(spark, T.document_type(t), t=name) == kind
    for n, c in ((0, 0), (1, 1), (450, 1), (451, 2), (500, 2), (900, 2), (901, 3)):
        assert len(one(spark, T.chunks(t), t=" ".join(f"w{i}" for i in range(n)))) == c == math.ceil(n / 450)
    made = one(spark, T.chunks(t), t=" ".join(f"w{i}" for i in range(500)))
    assert made[0].split()[-1] == "w499" and made[1].split()[0] == "w450"
    assert one(spark, T.valid_url(t), t="https://github.com/a/b.git") and not one(spark, T.valid_url(t), t="ftp://x")
    assert one(spark, T.readme(F.col("n"), F.col("l"), F.col("u")), n="x", l=None, u="y") == "# x\n\nLanguage: Unknown\nURL: y\n\nThis is an auto-discovered README document.\n"
    assert {one(spark, T.entity_key(t), t=x) for x in ("Payment Service", "payment-service", "payment_service")} == {"payment-service"}


def test_vectors(spark):
    a, b = (one(spark, S.stub_embedding(F.col("t")), t=x) for x in ("a", "b"))
    assert len(a) == 128 and abs(sum(x * x for x in a) - 1) < 1e-6 and a != b and a == one(spark, S.stub_embedding(F.col("t")), t="a")
    df = spark.createDataFrame([("d", ["one", " "], "x", 1), ("e", None, " ".join(f"w{i}" for i in range(92)), 3), ("f", None, None, 2), ("g", [], "a b", 4)], "document_id string, p array<string>, t string, n int")
    got = {r["document_id"]: r["x"] for r in df.select("document_id", vectors.chunk_texts(F.col("document_id"), F.col("p"), F.col("t"), F.col("n")).alias("x")).collect()}
    assert got["d"] == ["one", "d:chunk:1"] and got["f"] == ["f:chunk:0", "f:chunk:1"] and got["g"] == ["a", "b", "", ""]
    assert [len(x.split()) for x in got["e"]] == [30, 30, 32]
    assert vectors.embed(spark.createDataFrame([("d", ["x", "y"])], "document_id string, texts array<string>")).count() == 2


def test_manifests(spark):
    more = [("x/node_modules/package.json", '{"dependencies": {"no": "1"}}'), ("y/package.json", '{"dependencies": null}'), ("z/package.json", '{"dependencies": {"a": {"b": 1}}}'), ("w/requirements-dev.txt", "a[b]~=1 # x"), ("v/sub/package.json", '{"dependencies": {"q": "1"}}')]
    sources = {r["path"]: r["source_file"] for r in manifests.all_dependencies(spark.createDataFrame(more, "path string, content string")).collect()}
    assert sources["w/requirements-dev.txt"] == "requirements.txt" and sources["v/sub/package.json"] == "v/sub/package.json"
    got = sorted((r["path"], r["name"], r["version"]) for r in manifests.all_dependencies(spark.createDataFrame([*MANIFESTS, *more], "path string, content string")).collect())
    assert ("z/package.json", "a", "") in got and ("w/requirements-dev.txt", "a", "~=1 # x") in got and not any(p.startswith(("x/", "y/", "c/", "f/")) for p, *_ in got) and len(got) == 18


def test_listing(spark):
    a, b = (spark.createDataFrame(x, "id string, rank int") for x in ([("x", 1), ("y", 2)], [("y", 1)]))
    assert [r["id"] for r in listing.fuse({"a": a, "b": b}).collect()] == ["y", "x"]
    with pytest.raises(ValueError):
        listing.page(a, 0, 10, "id", "id")
    assert {r["token"] for r in listing.expand(spark.createDataFrame([("db",)], "token string"), spark.createDataFrame([("db", "database")], "token string, synonym string")).collect()} == {"db", "database"}
    assert listing.rerank(a.withColumn("s", F.lit(1.0)), {"s": 2.0, "rank": -1.0}).first()["id"] == "x"
    rows = spark.createDataFrame([("o1", "x", 1, True), ("o1", "y", 5, False), ("o2", "x", 9, True)], "organization_id string, kind string, at int, live boolean")
    assert listing.of_tenant(rows, "o1", since={"at": 1}, until={"at": 5}, any_of={"kind": ["x", "y"]}, live=True).count() == 1
    with pytest.raises(ValueError):
        listing.of_tenant(rows, None)
    best = listing.best_of_each(rows, "kind", "at")
    assert best.columns == rows.columns and {(r["kind"], r["at"]) for r in best.collect()} == {("x", 9), ("y", 5)}


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks of a few vectors give what a plain search gives; zeros, other dimensions and nulls take no part."""
    import numpy as np

    monkeypatch.setattr(vectors, "VECTORS", 7)
    monkeypatch.setattr(vectors, "QUERIES", 2)
    m = np.random.default_rng(3).standard_normal((40, 5))
    m[7] = m[3]
    some = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, [0.0] * 5), (101, [1.0] * 4), (102, None), (None, [1.0] * 5)]
    v = spark.createDataFrame(some, "id long, vector array<double>")
    got = vectors.top_similar_many(v, v.filter("id in (0, 3, 7, 100)").withColumnRenamed("id", "query_id"), 4).collect()
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for q in (0, 3, 7):
        s = np.round(unit @ unit[q], 6)
        want = [i for i in np.lexsort((np.arange(40), -s)).tolist() if i != q][:4]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert len(got) == 12
    embedded = vectors.embed(spark.createDataFrame([("d", "r1", ["x", "y" * 300])], "document_id string, repository_id string, texts array<string>"))
    assert vectors.records(embedded, "r2").count() == 0 and "vector" not in vectors.records(embedded).columns and "vector" in vectors.records(embedded, "r1", True).columns
    best = vectors.search_text(embedded, "x", 1).first()
    assert (best["document_id"], best["chunk_index"], best["preview"], best["score"]) == ("d", 0, "x", 1.0)


def test_files_of_a_repository(spark, tmp_path):
    from lodestone.sources import store

    (tmp_path / "sub").mkdir()
    (tmp_path / "requirements-dev.txt").write_text("flask>=2\n")
    (tmp_path / "sub" / "package.json").write_text('{"dependencies": {"a": "1"}}')
    (tmp_path / "sub" / "big.bin").write_bytes(b"x" * 5000)
    files = store.manifests(spark, str(tmp_path))
    assert {r["name"] for r in manifests.all_dependencies(files).collect()} == {"flask", "a"} and files.count() == 2
    assert store.folder_size_kb(spark, str(tmp_path)).first()["size_kb"] == 4
