"""Structure of large graphs: importance by power iteration, and strongly connected components by colouring.

edges: from_id, to_id (others are ignored; repeated ones count once). Each round is a join with the edges and a partial aggregate, written to the shared
folder, so plans do not grow and lost executors cost a round at most; nothing of the size of the graph reaches the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop_stored, stored

HOT = 100_000  # edges packed in one row
BLOCK, EDGES = 16, 2_000_000  # bits of a number within its block, at most 16; edges that a task sorts


def _packed(pairs: DataFrame, most: int) -> DataFrame:
    """block, froms, tos, firsts: the distinct pairs (f, t) of numbers, about `most` in a row and of one block of 2^BLOCK numbers f, in the order of t. froms are places
    in the block (16 bits), tos the numbers t (64 bits), firsts the place in the row where the edges to each of them begin (32 bits)."""
    rows = pairs.select(F.shiftright("f", BLOCK).alias("block"), "t", "f")
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // EDGES + 1)
    rows = rows.repartitionByRange(tasks, "block", "t", "f").sortWithinPartitions("block", "t", "f")

    def pack(held, last):
        block, t, f = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
        new[0] = (t[0], f[0]) != last
        block, t, f = block[new], t[new], f[new]
        bounds = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(f) else []
        for a, b in zip(bounds, bounds[1:]):
            first = np.flatnonzero(np.concatenate([[True], t[a + 1 : b] != t[a : b - 1]]))
            each = [(f[a:b] & (2**BLOCK - 1)).astype("<u2"), t[a:b][first].astype("<i8"), first.astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in each]], ["block", "froms", "tos", "firsts"])

    def run(batches):
        held, n, last = [], 0, None
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n >= most:
                yield from pack(held, last)
                last, held, n = (b.column(1)[-1].as_py(), b.column(2)[-1].as_py()), [], 0
        if n:
            yield from pack(held, last)

    return rows.mapInArrow(run, "block long, froms binary, tos binary, firsts binary")


def _degrees(packed: DataFrame) -> DataFrame:
    """n, out: the edges that leave each number."""

    def run(batches):
        for b in batches:
            for block, froms in zip(b.column(0).to_pylist(), b.column(1)):
                out = np.bincount(np.frombuffer(froms.as_buffer(), "<u2"))
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array((block << BLOCK) + at), pa.array(out[at])], ["n", "out"])

    return packed.select("block", "froms").mapInArrow(run, "n long, out long").groupBy("n").agg(F.sum("out").alias("out"))


def _handed(packed: DataFrame, shares: DataFrame) -> DataFrame:
    """n, got: what the edges hand on of shares (block, shares: places and shares), summed row by row of packed."""

    def run(batches):
        for b in batches:
            for froms, tos, firsts, shares in zip(*b.columns):
                share, own = np.zeros(2**BLOCK), shares.values
                share[own.field(0).to_numpy()] = own.field(1).to_numpy()
                got = np.add.reduceat(share[np.frombuffer(froms.as_buffer(), "<u2")], np.frombuffer(firsts.as_buffer(), "<i4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tos.as_buffer(), "<i8")), pa.array(got)], ["n", "got"])

    return packed.join(shares, "block").select("froms", "tos", "firsts", "shares").mapInArrow(run, "n long, got double").groupBy("n").agg(F.sum("got").alias("got"))


def importance(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 0.0, hot: int = HOT) -> DataFrame:
    """node_id, score: the share of visits of a random walk that follows an edge with the chance `damping`, and else starts again at any node of `nodes`
    (node_id); a node without edges hands what it has to all. Scores sum to 1. Ends after `rounds`, or once no score moves by more than
    `tolerance`. Edges from or to other nodes do not count. Nodes are numbered, and edges packed by blocks of numbers, `hot` or so in a row, so a round moves neither ids nor
    single edges: a block's scores meet its edges, and what these hand to a node is summed before it is moved."""
    own = stored(nodes.select("node_id").filter("node_id is not null").distinct().withColumn("n", F.monotonically_increasing_id()), "structure-nodes")
    n = own.count()
    if not n:
        return own.select("node_id", F.lit(0.0).alias("score"))
    known = edges.select("from_id", "to_id").join(own.toDF("from_id", "f"), "from_id").join(own.toDF("to_id", "t"), "to_id").select("f", "t")
    pairs = stored(known, "structure-edges")
    packed = stored(_packed(pairs, hot), "structure-packed")
    drop_stored(pairs)
    ranks = stored(own.select("n").join(_degrees(packed), "n", "left").withColumn("score", F.lit(1.0 / n)), "importance")
    for _ in range(rounds):
        dangling = ranks.filter("out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("d")).first()["d"]
        at = F.col("n").bitwiseAND(F.lit(2**BLOCK - 1)).cast("int")
        shares = ranks.filter("out is not null").groupBy(F.shiftright("n", BLOCK).alias("block")).agg(F.collect_list(F.struct(at.alias("at"), (F.col("score") / F.col("out")).alias("share"))).alias("shares"))
        score = F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("got", F.lit(0.0))
        new = stored(ranks.join(_handed(packed, shares), "n", "left").select("n", "out", score.alias("score"), F.abs(score - F.col("score")).alias("moved")), "importance")
        drop_stored(ranks)
        ranks = new
        if tolerance and new.agg(F.max("moved").alias("m")).first()["m"] <= tolerance:
            break
    drop_stored(packed)
    return own.join(ranks.select("n", "score"), "n").select("node_id", "score")


def _spread(start: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node_id, color): the greatest color that reaches each node of start along the edges, which begin and end in start. Only nodes whose color
    changed hand it on."""
    colors, front, old = start, start, []
    for _ in range(most):
        better = front.join(edges, front["node_id"] == edges["from_id"]).groupBy(F.col("to_id").alias("node_id")).agg(F.max("color").alias("more"))
        new = stored(colors.select("node_id", "color").join(better, "node_id", "left").select("node_id", F.greatest("color", "more").alias("color"), F.coalesce(F.col("more") > F.col("color"), F.lit(False)).alias("moved")), "colors")
        drop_stored(*old)
        colors, old = new, [new]
        front = new.filter("moved").select("node_id", "color")
        if front.isEmpty():
            return new.select("node_id", "color")
    raise RuntimeError(f"colors still moved after {most} steps")


def _back(colors: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node_id, color) of the nodes from which the root of their color, the node of that id, is reached within the color."""
    inner = edges.join(colors.select(F.col("node_id").alias("from_id"), F.col("color").alias("a")), "from_id").join(colors.select(F.col("node_id").alias("to_id"), F.col("color").alias("b")), "to_id").filter("a = b")
    inner = stored(inner.select("from_id", "to_id", F.col("a").alias("color")), "inner")
    front = stored(colors.filter("node_id = color"), "reached")
    levels = [front]
    for _ in range(most):
        seen = levels[0]
        for t in levels[1:]:
            seen = seen.union(t)
        new = front.select(F.col("node_id").alias("to_id")).join(inner, "to_id").select(F.col("from_id").alias("node_id"), "color").distinct().join(seen, "node_id", "left_anti")
        front = stored(new, "reached")
        if front.isEmpty():
            drop_stored(front, inner)
            return seen
        levels.append(front)
        if len(levels) > 20:  # one table again, so that no plan reads ever more of them
            merged = stored(seen.union(front), "reached")
            drop_stored(*levels)
            levels = [merged]
            front = merged
    raise RuntimeError(f"the way back took more than {most} steps")


def strong_components(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """node_id, component: the greatest id of the nodes that each node of `nodes` (node_id) reaches and is reached from, its own if there are no others.

    Round by round: nodes without a way in or out are their own component and go, again and again while that takes a tenth of the edges; each other takes the
    greatest id that reaches it as its color; of each color, what leads back to the node of that id within the color is its component. The rest
    goes on with the edges within one color, since no component has two. No table holds pairs of nodes that reach each other."""
    left = stored(edges.select("from_id", "to_id").filter("from_id is not null and to_id is not null and from_id <> to_id").distinct(), "left")
    found, size = [], left.count()
    for _ in range(most):
        while size:
            ins, outs = left.select(F.col("to_id").alias("from_id")).distinct(), left.select(F.col("from_id").alias("to_id")).distinct()
            inner = stored(left.join(ins, "from_id", "left_semi").join(outs, "to_id", "left_semi").select("from_id", "to_id"), "left")
            drop_stored(left)
            before, left, size = size, inner, inner.count()
            if size > 0.9 * before:
                break
        if not size:
            break
        ends = left.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
        colors = stored(_spread(stored(ends.select("node_id", F.col("node_id").alias("color")), "colors"), left, most), "colored")
        done = stored(_back(colors, left, most).select("node_id", F.col("color").alias("component")), "component")
        found.append(done)
        gone = done.select("node_id")
        rest = colors.join(gone, "node_id", "left_anti")
        inner = left.join(rest.select(F.col("node_id").alias("from_id"), F.col("color").alias("a")), "from_id").join(rest.select(F.col("node_id").alias("to_id"), F.col("color").alias("b")), "to_id").filter("a = b")
        inner = stored(inner.select("from_id", "to_id"), "left")
        drop_stored(left, colors)
        left, size = inner, inner.count()
    else:
        raise RuntimeError(f"components were left after {most} rounds")
    own = nodes.select("node_id").filter("node_id is not null").distinct()
    if not found:
        return own.withColumn("component", F.col("node_id"))
    every = found[0]
    for t in found[1:]:
        every = every.union(t)
    return own.join(every, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
