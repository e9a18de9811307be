"""Importance and strongly connected components against plain Python."""

import random

import pytest

from lodestone.operators import structure


def frames(spark, n, e):
    return spark.createDataFrame([(x,) for x in n], "node_id string"), spark.createDataFrame(list(e), "from_id string, to_id string")


def plain_components(n, e):
    def reach(x):
        seen, todo = set(), [x]
        while todo:
            at = todo.pop()
            for a, b in e:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {x: reach(x) for x in n}
    return {x: max([x, *(y for y in far[x] if x in far.get(y, ()))]) for x in n}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    n = [f"n{i:02d}" for i in range(40)]
    e = {(r.choice(n), r.choice(n)) for _ in range(45)} | {("n00", "n01"), ("n01", "n02"), ("n02", "n00"), ("n05", "n05")}
    got = {x["node_id"]: x["component"] for x in structure.strong_components(*frames(spark, [*n, "alone"], [*e, ("n00", "n01"), (None, "n01")])).collect()}
    assert got == plain_components([*n, "alone"], e)


def test_a_long_circle_and_a_chain(spark):
    n = [f"c{i:02d}" for i in range(30)] + ["x", "y"]
    e = [(n[i], n[(i + 1) % 30]) for i in range(30)] + [("c03", "x"), ("x", "y")]
    got = {x["node_id"]: x["component"] for x in structure.strong_components(*frames(spark, n, e)).collect()}
    assert {got[x] for x in n[:30]} == {"c29"} and got["x"] == "x" and got["y"] == "y"
    none = structure.strong_components(*frames(spark, [], []))
    assert none.collect() == [] and {r["component"] for r in structure.strong_components(*frames(spark, ["a"], [])).collect()} == {"a"}


@pytest.mark.parametrize("hot", [100_000, 2])
def test_importance(spark, hot):
    r = random.Random(3)
    n = [f"n{i}" for i in range(25)]
    e = {(r.choice(n[:20]), r.choice(n)) for _ in range(60)} | {("n0", x) for x in n[1:]}  # n0 points to all, the last five to none
    ranks = {x: 1 / len(n) for x in n}
    out = {x: [b for a, b in e if a == x] for x in n}
    for _ in range(15):
        loose = sum(ranks[x] for x in n if not out[x])
        new = {x: (0.15 + 0.85 * loose) / len(n) for x in n}
        for x in n:
            for b in out[x]:
                new[b] += 0.85 * ranks[x] / len(out[x])
        ranks = new
    got = {x["node_id"]: x["score"] for x in structure.importance(*frames(spark, n, [*e, ("n0", "n1"), ("zz", "n1"), ("n1", "zz")]), rounds=15, hot=hot).collect()}
    assert got.keys() == ranks.keys() and all(abs(got[x] - ranks[x]) < 1e-12 for x in n) and abs(sum(got.values()) - 1) < 1e-9
    early = structure.importance(*frames(spark, n, e), rounds=100, tolerance=1e-4, hot=hot).collect()
    assert all(abs(x["score"] - ranks[x["node_id"]]) < 1e-3 for x in early)


def test_edges_are_packed_by_blocks(spark, monkeypatch):
    """Small blocks and rows, repeated edges: each pair is packed once, in its block, and no round joins ids or single edges."""
    import numpy as np

    from lodestone.operators import structure

    pairs = {(f, t) for f in range(0, 90, 2) for t in (f % 7, f * f % 31, 2**33 + f)}
    table = spark.createDataFrame([*pairs, *pairs], "f long, t long").repartition(5)
    for bits, most in ((4, 10), (16, 100_000)):
        monkeypatch.setattr(structure, "BLOCK", bits)
        got = []
        for r in structure._packed(table, most).collect():
            f, t, first = np.frombuffer(r["froms"], "<u2"), np.frombuffer(r["tos"], "<i8"), np.frombuffer(r["firsts"], "<i4")
            got += [((r["block"] << bits) + int(a), int(b)) for a, b in zip(f, np.repeat(t, np.diff([*first, len(f)])))]
        assert sorted(got) == sorted(pairs)
    want = None
    for bits, most in ((2, 3), (16, 100_000)):
        monkeypatch.setattr(structure, "BLOCK", bits)
        e = spark.createDataFrame([(f"n{f % 40}", f"n{t % 37}") for f, t in pairs], "from_id string, to_id string")
        nodes = spark.createDataFrame([(f"n{i}",) for i in range(38)], "node_id string")
        scores = {r["node_id"]: round(r["score"], 12) for r in structure.importance(nodes, e, rounds=4, hot=most).collect()}
        assert want in (None, scores) and len(scores) == 38 and abs(sum(scores.values()) - 1) < 1e-9
        want = scores
