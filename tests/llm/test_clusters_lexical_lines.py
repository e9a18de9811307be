"""Centroid clustering, ranked lexical search and repeated lines against brute force in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import clusters, lexical, linededup

from test_operators import ODD, SCHEMA, rows

# --- centroid clustering


def plain_clusters(vectors, dim, k, rounds, scale=256, seed="2"):
    """(vec_id, cluster, distance) and the centroids, with Python's integers."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(scale * float(x)))) for x in v]) for i, v in vectors if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=rank)[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), centers


@pytest.mark.parametrize("k", [1, 3, 12])
def test_clusters(spark, k):
    r = np.random.default_rng(k)
    middle = r.normal(size=(6, 8))
    some = [(i, [float(x) for x in (middle[i % 6] if i % 3 else middle[0]) + 0.3 * r.normal(size=8)]) for i in range(300)]
    some += [(i, [float(i % 4)] * 8) for i in range(300, 360)]  # ties and copies
    some += [(7, [0.5] * 8), (7, [0.5] * 8), (None, [0.25] * 8), (400, None), (401, []), (402, [1.0] * 7), (403, [None] * 8), (404, [float("nan")] * 8), (405, [float("-inf")] * 8)]
    df = spark.createDataFrame([(*x, "mine", 1) for x in some], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    found, centers = clusters.cluster(df, dim=8, k=k, rounds=5)
    want, plain = plain_clusters(some, 8, k, 5)
    assert sorted(((x["vec_id"], x["cluster"], x["distance"]) for x in rows(found)), key=repr) == want and centers == plain
    got = rows(clusters.report(df, dim=8, k=k, rounds=5))
    assert {x["inertia"] for x in got} == {sum(d for _, _, d in want)}
    own = Counter()
    for _, c, d in want:
        own[c] += d
    assert all(x["cluster_inertia"] == own[x["cluster"]] and x["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[x["cluster"]])).encode()).hexdigest() for x in got)


def test_clusters_of_few_none_and_huge(spark):
    few = [(1, [1e30, -1e30]), (2, [3.0, 4.0]), (3, [3.0, 4.0]), (4, [-1e300, 0.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert sorted((x["vec_id"], x["cluster"], x["distance"]) for x in rows(clusters.cluster(df, dim=2, k=40)[0])) == plain_clusters(few, 2, 40, 5)[0]
    empty = clusters.report(df.limit(0), dim=2)
    assert rows(empty) == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_save_scans_and_change_nothing():
    r = np.random.default_rng(3)
    v = (256 * (r.normal(size=(20, 16))[r.integers(0, 20, 4000)] + 0.1 * r.normal(size=(4000, 16)))).astype(np.int64)
    centers, drift = v[:20].copy(), np.zeros(20)
    of, upper, lower, scans = np.full(len(v), -1), np.full(len(v), np.inf), np.zeros(len(v)), []
    for _ in range(8):
        of, upper, lower, n = clusters.assign(v, of, upper, lower, centers, drift)
        d = ((v[:, None] - centers[None]) ** 2).sum(axis=2)
        assert (of == d.argmin(axis=1)).all()
        scans.append(n)
        new = np.array([v[of == j].sum(axis=0) // max(1, (of == j).sum()) if (of == j).any() else centers[j] for j in range(20)])
        drift, centers = np.sqrt(((new - centers) ** 2).sum(axis=1)) * (1 + clusters.WIDER), new
    assert scans[0] == len(v) and scans[-1] < len(v) / 4


def test_squares_of_large_components():
    v = np.array([[1 << 27, -(1 << 27)], [5, 7]])
    apart = ((1 << 27) - 5) ** 2 + ((1 << 27) + 7) ** 2
    assert clusters.squares(v, v).tolist() == [[0, apart], [apart, 0]]


# --- ranked lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k):
    own = [(i, plain_terms(t)) for i, t in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(list)
    for item, text in dict.fromkeys(items):
        asked[item] += plain_terms(text)
    out = []
    for item, words in asked.items():
        scores = []
        for i, tf, n in own:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words if t in tf)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def as_tuples(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(df)), key=repr)


@pytest.mark.parametrize("postings", [3, 1 << 20])
def test_lexical(spark, postings):
    words = "alpha beta Gamma délta e_e f-g 42 ß İ the THE".split()
    r = np.random.default_rng(5)
    docs = [(i, " ".join(r.choice(words, size=int(r.integers(0, 12))))) for i in range(120)]
    docs += [(i, "alpha beta gamma") for i in range(200, 240)]  # ties at the cut
    docs += [(5, "alpha 42"), (5, "alpha 42"), (None, "alpha beta gamma"), (None, "ß"), (300, None), (301, ""), (302, "-- ++"), (303, "word " * 5000 + "alpha")]
    items = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "the"), (2, "ß ß 42 zzz"), (3, "zzz"), (4, ""), (5, None), (None, "délta e"), (6, "word"), (7, "Alpha, alpha; ALPHA!")]
    df = spark.createDataFrame([(*x, 3, "s") for x in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(*x, 3) for x in items], "item_id int, text string, doc_id int").repartition(2)
    index = lexical.build(df, postings)
    assert as_tuples(lexical.search(index, asked, 10)) == plain_search(docs, items, 10)
    assert index.shards.count() > 20 if postings == 3 else index.shards.count() <= 3


def test_lexical_in_many_blocks_and_passes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 7)
    monkeypatch.setattr(lexical, "BLOCKS", 2)
    docs, items = docs_of
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert as_tuples(got) == plain_search(docs, items, 4)


@pytest.fixture()
def docs_of():
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[int(x)] for x in np.minimum(59, r.geometric(0.1, n)))
    return [(i, text(30)) for i in range(150)], [(i, text(5)) for i in range(40)]


def test_lexical_of_odd_and_empty_tables(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "one two"), (2, "é"), (3, "word")], "item_id long, text string")
    assert as_tuples(lexical.rank(odd, items)) == plain_search([r[:2] for r in ODD], [(1, "one two"), (2, "é"), (3, "word")], 10)
    assert rows(lexical.rank(none, items)) == [] and rows(lexical.rank(odd, items.limit(0))) == []
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce("doc_id", F.lit(0)).cast("string")))
    assert {r["doc_id"] for r in rows(lexical.rank(named, items.filter("item_id = 3")))} == {"d5"}


# --- repeated lines

WHITE = " \t\n\x0b\x0c\r"


def plain_lines(docs, least_docs, least_chars):
    key = lambda line: re.sub("[A-Z]+", lambda m: m.group().lower(), line.strip(WHITE))
    order = lambda i: (i is not None, i or 0)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    holders = defaultdict(list)
    for i, lines in split:
        for k in {key(x) for x in lines}:
            if len(k) >= least_chars:
                holders[k].append(i)
    last = {k: max(v, key=order) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, lines in split:
        left = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def line_rows(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows(df)), key=repr)


@pytest.mark.parametrize("held", [1 << 26, 0])
def test_lines(spark, held, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD", 16)
    monkeypatch.setattr(linededup, "GROUP", 50)
    r = np.random.default_rng(7)
    pool = [f"line {i} " + "x" * int(i % 17) for i in range(60)] + ["ÉCOLE Ünïcode line of ten", "   ", ""]
    dress = [lambda x: x, str.upper, lambda x: f"\t {x}\r", lambda x: x + "\x0b\x0c"]
    docs = [(i, "\n".join(dress[int(r.integers(4))](pool[int(j)]) for j in r.integers(0, len(pool), int(r.integers(0, 15))))) for i in range(150)]
    docs += [(i, "A very common line of all\nown line number %d" % i) for i in range(500, 700)]  # a hot line
    docs += [(None, "only without ids, this line"), (None, "only without ids, this line\nA very common line of all"), (None, "only without ids, this line"), (9, None), (10, ""), (11, "\n\n")]
    docs += [(699, "a very common line of all"), (12, "line 16 " + "x" * 16 + "\n") , (12, "line 16 " + "x" * 16 + "\n"), (13, " line 16 " + "x" * 16)]
    df = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, a int, last string").repartition(4)
    for least, chars in ((3, 10), (5, 20)):
        assert line_rows(linededup.drop_repeated(df, least, chars, held)) == plain_lines(docs, least, chars)


def test_lines_of_odd_and_empty_tables(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    for held in (1 << 26, 0):
        assert line_rows(linededup.drop_repeated(odd, 2, 20, held)) == plain_lines([r[:2] for r in ODD], 2, 20)
        assert rows(linededup.drop_repeated(none, held=held)) == []
    named = spark.createDataFrame([(f"d{i}", "the same line in five documents") for i in range(5)], "doc_id string, text string")
    for held in (1 << 26, 0):
        assert {r["doc_id"]: r["n_dropped"] for r in rows(linededup.drop_repeated(named, 5, 10, held))} == {"d0": 1, "d1": 1, "d2": 1, "d3": 1, "d4": 0}
    with pytest.raises(ValueError):
        linededup.drop_repeated(odd, 1)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    a, b = r.integers(0, 1 << 63, n).astype(np.uint64), np.arange(n).astype(np.uint64)
    a[: n // 2] = a[:1]  # halves of the hash that agree are told apart by the other half
    made = linededup.PerfectHash.build(a, b)
    assert sorted(made.places(a, b).tolist()) == list(range(n))
    assert len(made.words) * 64 < 6 * n + 1000
    other = made.places(a, b + np.uint64(n))
    assert ((other >= -1) & (other < max(n, 1))).all()
