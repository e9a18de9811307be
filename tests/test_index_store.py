"""The stored index: equal to one built anew after any changes, safe against dying and meeting writers, read in part; fuzzy pairs, phrases."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, search
from lodestone.sources.reads import Reads
from lodestone.sources.versions import Versions

WORDS = [f"{a}{b}" for a in ("pay", "bill", "serv", "log", "kit", "sit", "data", "graph") for b in ("ment", "ing", "ice", "s", "er", "tten")]
QUERIES = ["payment billing", "pay", "paymnt servce", "logger logger kitten", "zzz", "graphs datas sits"]


def corpus(spark, some):
    return spark.createDataFrame([(i, "a" if i % 3 else "b", t) for i, t in some], "id long, type string, text string")


def made(seed, ids):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 30)))) for i in ids]


def found(df):
    return [(r["id"], r["score"], r["tfidf"], r["match_type"]) for r in df.collect()]


def same(spark, store, want):
    """The stored index answers as one derived from the rows it should hold."""
    plain = corpus(spark, sorted(want.items()))
    t = store.tables()
    for q in QUERIES:
        assert sorted(found(search.search(t, q, 7))) == sorted(found(search.search(plain, q, 7))), q
    assert sorted(found(search.search(t, "payment", 5, type="b"))) == sorted(found(search.search(plain, "payment", 5, type="b")))
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    many = lambda x: sorted((r["query_id"], r["rank"], r["id"], r["score"], r["match_type"]) for r in search.search_many(x, asked, 6, fuzzy=True).collect())
    assert many(t) == many(plain)
    s = store.stats().first()
    assert s["documents"] == len(want) and s["vocabulary"] == plain.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).distinct().count()


def test_changes_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SHARE", 9.0)
    store, want = index.Store(spark, str(tmp_path / "i")), dict(made(1, range(150)))
    store.add(corpus(spark, want.items()))
    same(spark, store, want)
    new = dict(made(2, range(140, 160)))
    store.add(corpus(spark, new.items()))
    want |= new
    store.remove(spark.createDataFrame([(0,), (5,), (155,), (999,)], "id long"))
    want = {i: t for i, t in want.items() if i not in (0, 5, 155)}
    again = {5: "payment back again", 7: ""}
    store.add(corpus(spark, again.items()))
    want |= again
    assert len(store.state()["segments"]) == 4
    same(spark, store, want)
    store.merge()
    assert len(store.state()["segments"]) == 1
    same(spark, store, want)
    s = store.stats().first()
    assert (s["total_indexed"], s["total_removed"]) == (172, 3)
    left = len(store.versions.names("data"))
    assert store.vacuum(keep=1, older_than=0.0) > 3 and len(store.versions.names("data")) == 1 < left
    same(spark, store, want)


def test_a_small_change_costs_little(spark, tmp_path):
    def size(names):
        return sum(os.path.getsize(os.path.join(d, f)) for n in names for d, _, fs in os.walk(tmp_path / "i" / "data" / n) for f in fs if f.endswith(".parquet"))

    r = random.Random(4)
    text = lambda: " ".join(f"w{int(r.paretovariate(0.3)) % 20000}" for _ in range(200))
    store = index.Store(spark, str(tmp_path / "i")).add(corpus(spark, [(i, text()) for i in range(1500)]))
    base = set(store.versions.names("data"))
    with Reads(spark, "postings") as reads:
        store.add(corpus(spark, [(i, text()) for i in range(5000, 5015)]))
    now = set(store.versions.names("data"))
    assert size(now - base) < size(base) / 20 and base < now
    assert 0 < reads.rows <= 15 * 200  # its own postings alone
    with Reads(spark, "postings") as reads:
        store.remove(spark.createDataFrame([(5001,)], "id long"))
    assert reads.rows == 0 and size(set(store.versions.names("data")) - now) < size(base) / 20


def test_changes_alone_do_not_merge(spark, tmp_path, monkeypatch):
    """However great a share of the documents changes make up, neither they, nor counts, nor the first read of a version build the index anew; the second read does."""
    merged, by = [], index.Store.merge
    monkeypatch.setattr(index.Store, "merge", lambda self: merged.append(1) or by(self))
    store = index.Store(spark, str(tmp_path / "i")).add(corpus(spark, [(1, "payment one"), (2, "payment two"), (3, "billing")]))
    store.add(corpus(spark, [(2, "now payment"), (4, "payment payment")])).remove(spark.createDataFrame([(1,)], "id long"))
    want = found(search.search(corpus(spark, [(2, "now payment"), (3, "billing"), (4, "payment payment")]), "payment", 5, fuzzy=False))
    s = store.stats().first()
    assert (s["documents"], s["vocabulary"], s["total_indexed"], s["total_removed"]) == (3, 3, 5, 1)
    assert found(search.search(store.tables(), "payment", 5, fuzzy=False)) == want and len(want) == 2
    assert not merged and len(store.state()["segments"]) == 3
    assert found(search.search(store.tables(), "payment", 5, fuzzy=False)) == want
    assert merged == [1] and len(store.state()["segments"]) == 1


@pytest.mark.parametrize("step", ["entries", "effect", "commit"])
@pytest.mark.parametrize("kind", ["add", "remove"])
def test_a_change_that_dies_is_never_seen(spark, tmp_path, monkeypatch, step, kind):
    store = index.Store(spark, str(tmp_path / "i")).add(corpus(spark, [(1, "payment one"), (2, "payment two"), (3, "billing")] + made(3, range(10, 30))))

    def die(*a, **k):
        raise OSError("killed")

    before = store.stats().first()
    with monkeypatch.context() as m:
        m.setattr(*{"entries": (index.Store, "_write_entries"), "effect": (index.Store, "_effect"), "commit": (Versions, "commit")}[step], die)
        if kind == "add" or step != "entries":
            with pytest.raises(OSError):
                store.add(corpus(spark, [(9, "payment nine")])) if kind == "add" else store.remove(spark.createDataFrame([(1,)], "id long"))
    assert store.stats().first() == before
    ids = lambda: sorted(r["id"] for r in search.search(index.Store(spark, str(tmp_path / "i")).tables(), "payment", 50, fuzzy=False).collect() if r["id"] < 10)
    assert ids() == [1, 2]
    store.remove(spark.createDataFrame([(2,)], "id long")) if kind == "add" else store.add(corpus(spark, [(4, "payment four")]))
    assert ids() == ([1] if kind == "add" else [1, 2, 4])
    s = store.stats().first()
    assert (s["total_indexed"], s["total_removed"]) == ((23, 1) if kind == "add" else (24, 0))


def test_writers_that_meet(spark, tmp_path):
    folder = str(tmp_path / "i")
    want = dict(made(6, range(40)))
    index.Store(spark, folder).add(corpus(spark, want.items()))
    errors = []

    def work(who):
        try:
            index.Store(spark, folder).add(corpus(spark, [(1000 + who, "payment billing " * who), (who, "service")]))
            index.Store(spark, folder).remove(spark.createDataFrame([(20 + who,)], "id long"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    for w in (1, 2):
        want |= {1000 + w: "payment billing " * w, w: "service"}
        del want[20 + w]
    same(spark, index.Store(spark, folder), want)


def test_repeated_ids_take_one_row(spark, tmp_path):
    rows = corpus(spark, [(1, f"word{i} shared") for i in range(20)]).repartition(5)
    store = index.Store(spark, str(tmp_path / "i")).add(rows)
    assert store.stats().first()["documents"] == 1 and store.tables().postings.count() == 2
    entry, tokens = store.tables().entries.first(), {r["token"] for r in store.tables().postings.collect()}
    assert {w["token"] for w in entry["words"]} == tokens
    again = index.Store(spark, str(tmp_path / "j")).add(rows.repartition(2))
    assert {r["token"] for r in again.tables().postings.collect()} == tokens


def test_blocks_are_skipped(spark, tmp_path):
    r = random.Random(5)
    docs = [(i, " ".join(["common"] + [f"w{r.randrange(3000)}" for _ in range(r.randrange(1, 120))])) for i in range(4000)]
    store = index.Store(spark, str(tmp_path / "i")).add(corpus(spark, docs))
    t = store.tables()
    assert t.bounds.count() > 40
    every = t.postings.count()
    for q in ("common", "common w17", "w5 w6 w7"):
        with Reads(spark, "postings") as reads:
            got = found(search.search(t, q, 5, fuzzy=False))
        assert 0 < reads.rows < every / 10, (q, reads.rows, every)
        assert got == found(search.search(corpus(spark, docs), q, 5, fuzzy=False))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
def test_fuzzy_pairs(spark, most):
    r = random.Random(most)
    words = {"".join(r.choice("ab1") for _ in range(r.randrange(1, 13))) for _ in range(150)} | {"a", "b", "payment", "x" * 400}
    known = {"".join(r.choice("ab1") for _ in range(r.randrange(1, 13))) for _ in range(250)} | {"a", "1", "paymnt", "paymentss", "x" * 398 + "yy"}
    column = lambda some: spark.createDataFrame([(w,) for w in some], "token string")
    got = {(x["a"], x["b"]): x["distance"] for x in search.fuzzy_pairs(column(words), column(known), most).collect()}
    want = {(a, b): d for a in words for b in known if a != b and abs(len(a) - len(b)) <= most for d in [levenshtein(a, b)] if d <= most}
    assert got == want


def test_phrases_and_spans(spark, tmp_path):
    docs = [(1, "a b a b c"), (2, "a b c a b"), (3, "b a b a"), (4, "a-a A"), (5, "a b"), (6, ""), (7, None), (8, "c x x x x a b")]
    store = index.Store(spark, str(tmp_path / "i")).add(corpus(spark, docs))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    for own in (store.tables(), corpus(spark, docs)):
        for q in ("a b a", "a b", "a a a", "b c", "a b a b", "c", "a zzz", "b a b"):
            want = [i for i, t in docs if f" {' '.join(search.tokens_of(q))} " in f" {' '.join(search.tokens_of(t or ''))} "]
            assert ids(search.phrase(own, q)) == want, q
        assert ids(search.near(own, "c a b", 3)) == [1, 2] and ids(search.near(own, "c a b", 7)) == [1, 2, 8] and ids(search.near(own, "a", 1)) == [1, 2, 3, 4, 5, 8]
        assert ids(search.phrase(own, " ")) == [] == ids(search.near(own, "", 3))
    store.add(corpus(spark, [(1, "nothing"), (9, "x a b a")]))
    assert ids(search.phrase(store.tables(), "a b a")) == [3, 9] == [i for i in ids(search.phrase(store.tables(), "b a")) if i != 2]
