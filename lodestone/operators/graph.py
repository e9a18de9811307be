"""The property graph: folding events into nodes and edges, reads, and traversal.

nodes: node_id, label, props, created_at, updated_at. edges: from_id, to_id, type, created_at.
Traversal goes level by level as a join of the frontier with the edges and an anti-join with what was visited; each level is
written to the shared folder, so the plan does not grow and cycles end by themselves.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop_stored, small_or_not, stored
from .search import check

LABELS = ("Repository", "Document", "Service", "Team", "Developer", "Dependency", "Commit")
PAIRS, EDGES = 4_000_000, 500_000  # pairs that a task counts at once, and edges that it has
TYPES = ("DESCRIBES", "DEPENDS_ON", "OWNS", "AUTHORED_BY", "COMMITTED_TO", "USES", "BELONGS_TO", "CREATED_BY", "REFERENCES", "PRODUCES")


def _get(path: str):
    return F.get_json_object("payload", f"$.{path}")


def _props(*names: str):
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[_get(n) for n in names]))


def _text(name: str):
    return F.coalesce(_get(name), F.lit(""))


def _prepared(events: DataFrame) -> DataFrame:
    """Events with their repository, its state before the event, and the place of the event in the order."""
    e = events.withColumn("repo", _get("repositoryId")).withColumn("at", F.struct("timestamp", "eventId"))
    state = F.when(F.col("eventType").isin("RepositoryCreated", "RepositoryCloned"), 1).when(F.col("eventType") == "RepositoryDeleted", 0)
    each = F.coalesce("repo", F.concat(F.lit("no repository "), "eventId"))  # events without a repository stand alone, not in one window
    w = Window.partitionBy(each).orderBy("at")
    alive = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return e.withColumn("alive", alive & F.col("repo").isNotNull()).withColumn("gone", F.max(F.when(F.col("eventType") == "RepositoryDeleted", F.col("at"))).over(Window.partitionBy(each)))


def node_parts(events: DataFrame) -> DataFrame:
    """What the events of each repository say of each node: node_id, repo, first (at, label), created_at, updated_at, made, props (key, at, value).
    It follows from the events of that repository alone. What an event writes is an array that is exploded, so that the log is read and
    ordered once."""
    e = _prepared(events)
    kind, repo = F.col("eventType"), F.col("repo")
    kept = F.col("gone").isNull() | (F.col("at") > F.col("gone"))
    changed = F.coalesce(F.from_json(_get("changedFields"), "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    org = F.map_concat(_props("name", "url", "language", "visibility", "defaultBranch"), F.create_map(F.lit("organizationId"), F.col("organizationId")))
    cloned = F.map_concat(F.create_map(F.lit("cloneStatus"), F.lit("success")), _props("commitCount", "sizeKb", "clonedAt"))
    commit = F.map_concat(
        _props("sha", "authorEmail", "authorName", "committedAt", "repositoryId"),
        F.create_map(F.lit("message"), F.substring(_text("message"), 1, 200), F.lit("filesChanged"), F.coalesce(F.json_array_length(_get("filesChanged")), F.lit(0)).cast("string")),
    )
    write = lambda where, id_, label, props, makes=True: F.when(where, F.struct(id_.alias("node_id"), F.lit(label).alias("label"), props.alias("props"), F.lit(makes).alias("makes")))
    writes = F.array(
        write((kind == "RepositoryCreated") & kept, repo, "Repository", org),
        write((kind == "RepositoryUpdated") & kept & F.col("alive") & (F.size(changed) > 0), repo, "Repository", changed, False),
        write((kind == "RepositoryCloned") & kept, repo, "Repository", cloned),
        write(kind == "DocumentProcessed", _get("documentId"), "Document", _props("fileName", "documentType", "chunkCount", "wordCount", "repositoryId")),
        write(kind == "DependencyDetected", dependency_id(), "Dependency", _props("name", "version", "ecosystem", "sourceFile")),
        write(kind == "CommitAnalyzed", F.concat(F.lit("commit:"), _text("sha")), "Commit", commit),
        write((kind == "CommitAnalyzed") & (F.length(_text("authorEmail")) > 0), F.concat(F.lit("developer:"), _get("authorEmail")), "Developer", F.create_map(F.lit("email"), _get("authorEmail"), F.lit("name"), _get("authorName"))),
    )
    rows = e.select(F.coalesce("repo", F.concat(F.lit("no repository "), "eventId")).alias("repo"), "at", "timestamp", F.explode(F.array_compact(writes)).alias("w")).select("repo", "w.*", "at", "timestamp")
    key = ["node_id", "repo"]
    first = F.min(F.struct("at", "label")).alias("first")
    times = rows.groupBy(*key).agg(first, F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.max("makes").alias("made"))
    values = rows.select(*key, "at", F.explode("props").alias("k", "v")).filter("v is not null").groupBy(*key, "k").agg(F.max(F.struct("at", "v")).alias("b"))
    props = values.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "b.at", "b.v"))).alias("props"))
    return times.join(props, key, "left").withColumn("props", F.coalesce("props", F.array().cast(props.schema["props"].dataType)))


def join_nodes(parts: DataFrame) -> DataFrame:
    """Nodes of the parts of all repositories: a node that several share has the last value of each property."""
    times = parts.groupBy("node_id").agg(F.min("first").alias("first"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("made").alias("made")).filter("made")
    values = parts.select("node_id", F.explode("props").alias("p")).groupBy("node_id", F.col("p.k").alias("k")).agg(F.max(F.struct("p.at", "p.v")).alias("b"))
    props = values.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "b.v")))).alias("props"))
    return times.join(props, "node_id", "left").select("node_id", F.col("first.label").alias("label"), "props", "created_at", "updated_at")


def fold_nodes(events: DataFrame) -> DataFrame:
    """Nodes after all events: properties are patched key by key, nulls never overwrite, a deletion forgets what came before. Documents,
    dependencies, commits and developers outlive their repository."""
    return join_nodes(node_parts(events))


def dependency_id():
    return F.concat(F.lit("dep:"), F.coalesce(_get("ecosystem"), F.lit("unknown")), F.lit(":"), _text("name"), F.lit(":"), _text("version"))


def edge_parts(events: DataFrame, eventual: bool = False) -> DataFrame:
    """The first write of each edge by each repository: from_id, to_id, type, repo, created_at. It follows from the events of that repository alone."""
    e = _prepared(events)
    kind, repo = F.col("eventType"), F.col("repo")
    commit = F.concat(F.lit("commit:"), _text("sha"))
    after = (F.col("gone").isNull()) | (F.col("at") > F.col("gone"))
    if eventual:
        living = e.filter(kind.isin("RepositoryCreated", "RepositoryCloned") & after).select("repo", F.lit(True).alias("lives")).distinct()
        e = e.join(living, "repo", "left")
        there = F.coalesce("lives", F.lit(False))
    else:
        there = F.col("alive") & after
    write = lambda where, a, b, t: F.when(where, F.struct(a.alias("from_id"), b.alias("to_id"), F.lit(t).alias("type")))
    writes = F.array(
        write(there & (kind == "DocumentProcessed"), _get("documentId"), repo, "DESCRIBES"), write(there & (kind == "DependencyDetected"), repo, dependency_id(), "DEPENDS_ON"),
        write(there & (kind == "CommitAnalyzed"), commit, repo, "COMMITTED_TO"),
        write((kind == "CommitAnalyzed") & (F.length(_text("authorEmail")) > 0), F.concat(F.lit("developer:"), _get("authorEmail")), commit, "AUTHORED_BY"),
    )
    rows = e.select(F.coalesce("repo", F.concat(F.lit("no repository "), "eventId")).alias("repo"), "timestamp", F.explode(F.array_compact(writes)).alias("w")).select("w.*", "repo", "timestamp")
    return rows.groupBy("from_id", "to_id", "type", "repo").agg(F.min("timestamp").alias("created_at"))


def join_edges(parts: DataFrame) -> DataFrame:
    return parts.groupBy("from_id", "to_id", "type").agg(F.min("created_at").alias("created_at"))


def fold_edges(events: DataFrame, eventual: bool = False) -> DataFrame:
    """Edges after all events: the first write of (from, to, type) counts; an edge to a repository needs the repository to be there at
    that event (eventual: at the end), and goes with it."""
    return join_edges(edge_parts(events, eventual))


def graph_updates(events: DataFrame) -> DataFrame:
    """What each event reports: attempts to make nodes and edges, existing ones included."""
    e = _prepared(events)
    kind, mail = F.col("eventType"), (F.length(_text("authorEmail")) > 0).cast("int")
    here = F.col("alive").cast("int")
    nodes = F.when(kind.isin("RepositoryCreated", "DocumentProcessed", "DependencyDetected"), 1).when(kind == "CommitAnalyzed", 1 + mail).when((kind == "RepositoryUpdated"), 0)
    rels = F.when(kind.isin("DocumentProcessed", "DependencyDetected"), here).when(kind == "CommitAnalyzed", here + mail).otherwise(0)
    return e.select("eventId", kind.alias("trigger_event"), nodes.alias("nodes_created"), rels.alias("relationships_created")).filter("nodes_created is not null")


def list_nodes(nodes: DataFrame, label: str | None = None) -> DataFrame:
    if label is not None and label not in LABELS:
        raise ValueError(f"unknown label {label}")
    return nodes if label is None else nodes.filter(F.col("label") == label)


def list_edges(edges: DataFrame, from_id=None, to_id=None, type: str | None = None) -> DataFrame:
    if type is not None and type not in TYPES:
        raise ValueError(f"unknown type {type}")
    for column, value in (("from_id", from_id), ("to_id", to_id), ("type", type)):
        edges = edges if value is None else edges.filter(F.col(column) == value)
    return edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by label and by type, and totals (name null), in one pass over each."""
    n = nodes.rollup("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return n.union(edges.rollup("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n"))


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes (node_id) and what touches them."""
    left = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left.join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti").select(*edges.columns)


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """First write of each (from, to, type) whose ends both exist."""
    rows = edges.join(nodes.select(F.col("node_id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("node_id").alias("to_id")), "to_id", "left_semi")
    return rows.groupBy("from_id", "to_id", "type").agg(F.min("created_at").alias("created_at"))


def match(nodes: DataFrame, edges: DataFrame, type: str | None = None, from_label: str | None = None, to_label: str | None = None) -> DataFrame:
    """(a)-[type]->(b) with both ends: every column of nodes once as from_ and once as to_, and the columns of the edge between them."""
    end = lambda side, label: list_nodes(nodes, label).select(*[F.col(c).alias(f"{side}_id" if c == "node_id" else f"{side}_{c}") for c in nodes.columns])
    return list_edges(edges, type=type).join(end("from", from_label), "from_id").join(end("to", to_label), "to_id")


def walk(edges: DataFrame, starts: DataFrame, types: list[str], reverse: bool = False) -> DataFrame:
    """start, node_id: where each start gets by edges of these types, one after the other; ownership is such a walk along OWNS and
    BELONGS_TO."""
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    at = starts.select("start", F.col("start").alias("node_id")).distinct()
    for t in types:
        step = edges.filter(F.col("type") == t).select(F.col(a).alias("node_id"), F.col(b).alias("next"))
        at = at.join(step, "node_id").select("start", F.col("next").alias("node_id")).distinct()
    return at


def reach(edges: DataFrame, starts: DataFrame, hops: int, reverse: bool = False) -> DataFrame:
    """start, node_id, hops: what each start (start) reaches within some hops along the edges, by the shortest way; the start at 0."""
    check("hops", hops, 1, 1000)
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    steps = stored(edges.select(F.col(a).alias("node_id"), F.col(b).alias("next")).distinct(), "steps")
    seen = starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("hops"))
    frontier = seen
    for level in range(1, hops + 1):
        new = frontier.join(steps, "node_id").select("start", F.col("next").alias("node_id")).distinct().join(seen, ["start", "node_id"], "left_anti").withColumn("hops", F.lit(level))
        frontier = stored(new, "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node_id, hops, path: the shortest path from each start to what it reaches; of several the first in the order of its nodes."""
    check("hops", hops, 1, 1000)
    steps = stored(edges.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("next")).distinct(), "steps")
    seen = starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("hops"), F.array("start").alias("path"))
    frontier = seen
    for level in range(1, hops + 1):
        new = frontier.join(steps, "node_id").groupBy("start", F.col("next").alias("node_id")).agg(F.min("path").alias("path"))
        new = new.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        frontier = stored(new.select("start", "node_id", F.lit(level).alias("hops"), F.concat("path", F.array("node_id")).alias("path")), "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def in_cycles(edges: DataFrame, hops: int) -> DataFrame:
    """Nodes that reach themselves within some hops, and in how many. Nodes without a way in or out are trimmed first, again and again (at
    most `hops` times): what is left is searched from each node."""
    left = stored(edges.select("from_id", "to_id").distinct(), "cycles")
    count = left.count()
    for _ in range(hops):
        inner = left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi")
        left = stored(inner.select("from_id", "to_id"), "cycles")
        before, count = count, left.count()
        if count == before:
            break
    starts = left.select(F.col("from_id").alias("start")).distinct()
    far = reach(left, starts, max(1, hops - 1))
    back = far.join(left.select(F.col("from_id").alias("node_id"), "to_id"), "node_id").filter("to_id = start")
    return back.groupBy("start").agg((F.min("hops") + 1).alias("length")).withColumnRenamed("start", "node_id")


def _pair_counts(lists: DataFrame, mirrored: bool) -> DataFrame:
    """a, b, n of the pairs of lists (a, b), or of each two of a list (a, null), counted where the lists are read. If mirrored, a pair and its mirror are one, the
    lesser first. The counts of a pair from several batches are not yet summed."""
    kind = lists.schema["a"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            coded = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
            names, rank = coded.dictionary, np.empty(len(coded.dictionary), np.int64)
            rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
            codes = rank[coded.indices.to_numpy()]
            names = names.take(pc.array_sort_indices(names))
            sizes, others = (pc.fill_null(c.value_lengths(), 0).to_numpy().astype(np.int64) for c in (a, b))
            ends, total = np.cumsum(sizes), int(sizes.sum())
            row, at, alone = np.repeat(np.arange(len(sizes)), sizes), np.arange(total), b.is_null().to_numpy(zero_copy_only=False)[np.repeat(np.arange(len(sizes)), sizes)]
            n = np.where(alone, ends[row] - 1 - at, others[row])  # partners of each of the first list
            partner = np.where(alone, at + 1, total + (np.cumsum(others) - others)[row])
            done = np.cumsum(n)
            low = 0
            while low < total:
                high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, "right")))
                some = n[low:high]
                left = np.repeat(codes[low:high], some)
                right = codes[np.repeat(partner[low:high] - (np.cumsum(some) - some), some) + np.arange(len(left))]
                low = high
                key = np.minimum(left, right) * len(names) + np.maximum(left, right) if mirrored else (left * len(names) + right)[left != right]
                if len(key):
                    key, count = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(key // len(names))), names.take(pa.array(key % len(names))), pa.array(count, pa.int64())], ["a", "b", "n"])

    return lists.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}, n long")


def derived_edges(first: DataFrame, second: DataFrame, type: str = "INTERACTS_WITH", most: int = 1000) -> DataFrame:
    """(a)-[first]->(x)<-[second]-(b) gives (a)-[type]->(b), with the count of x as evidence. The pairs of one x are as many as the product of its
    edges; they are counted where the lists of edges of many x lie, in the order of x, so that only counts of pairs are moved. An x with more than `most` edges on a side is
    dealt out in parts of that size, each of which meets all parts of the other side. If both are the same table, pairs are counted once and mirrored."""
    same = first is second

    def lists(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = edges.select(F.col("from_id").alias(name), F.col("to_id").alias("x")).filter(f"{name} is not null and x is not null")
        each = stored(own.groupBy("x").agg(F.count("*").alias("n")), "degrees")
        parts = stored(each.filter(F.col("n") > most).select("x", F.ceil(F.col("n") / most).cast("int").alias("parts")), "hot-nodes")
        n = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        drop_stored(each)
        own = own.join(small_or_not(parts), "x", "left").select("x", name, F.pmod(F.xxhash64(name), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // EDGES + 1)
        return own.repartitionByRange(tasks, "x", "part").groupBy("x", "part").agg(F.collect_set(name).alias(name)), parts

    a, parts = lists(first, "a")
    none = F.lit(None).cast(a.schema["a"].dataType).alias("b")
    if same:
        counts = _pair_counts(a.select("a", none), True)
        if not parts.isEmpty():
            hot = stored(a.join(small_or_not(parts), "x"), "hot-lists")
            later = hot.filter("part > 0").select("x", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"), F.col("a").alias("b"))
            counts = counts.union(_pair_counts(hot.select("x", "part", "a").join(later.hint("merge"), ["x", "part"]).select("a", "b"), True))
    else:
        b, _ = lists(second, "b")
        b = b.drop("part").join(small_or_not(parts), "x", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        counts = _pair_counts(a.join(b.select("x", "part", "b").hint("merge"), ["x", "part"]).select("a", "b"), False)
    summed = counts.groupBy("a", "b").agg(F.sum("n").alias("evidence"))
    if same:
        both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        summed = summed.select(both.alias("p"), "evidence").select("p.a", "p.b", "evidence")
    return summed.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit(type).alias("type"), "evidence", F.lit(True).alias("inferred"))


def propagate(scores: DataFrame, edges: DataFrame, keep: float = 0.5, rounds: int = 2) -> DataFrame:
    """node_id, confidence: each node has the best of its own confidence (node_id, confidence) and `keep` times that of a node with an edge to it,
    round by round. The formula is our own."""
    steps = edges.select(F.col("from_id").alias("node_id"), "to_id").distinct()
    for _ in range(rounds):
        handed = scores.join(steps, "node_id").select(F.col("to_id").alias("node_id"), (F.col("confidence") * keep).alias("confidence"))
        scores = stored(scores.select("node_id", "confidence").union(handed).groupBy("node_id").agg(F.round(F.max("confidence"), 6).alias("confidence")), "confidence")
    return scores


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree and instability, out / (in + out)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.round(F.try_divide("out_degree", F.col("in_degree") + F.col("out_degree")), 6).alias("instability"))


def hotspots(degrees: DataFrame, critical: int, god: int) -> DataFrame:
    """Nodes that at least `critical` others point to, and those with at least `god` edges in all."""
    both = F.col("in_degree") + F.col("out_degree")
    return degrees.select("node_id", (F.col("in_degree") >= critical).alias("critical"), (both >= god).alias("god_object")).filter("critical or god_object")


def confidence(evidence: DataFrame, half_life_days: float = 90.0, now: str = "2024-02-01") -> DataFrame:
    """Confidence of an object from its evidence (node_id, weight 0..1, seen_at): 1 - product of (1 - weight * 2^(-age / half life)), and its
    tier. The formula is our own; the tier bounds are 0.90, 0.75, 0.60 and 0.40."""
    age = F.greatest(F.datediff(F.to_date(F.lit(now)), F.to_date("seen_at")), F.lit(0))
    left = F.greatest(1 - F.col("weight") * F.pow(F.lit(2.0), -age / half_life_days), F.lit(1e-12))
    c = F.round(1 - F.exp(F.sum(F.log(left))), 6)
    tier = F.when(F.col("confidence") >= 0.9, "very high").when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.6, "medium").when(F.col("confidence") >= 0.4, "low").otherwise("very low")
    return evidence.groupBy("node_id").agg(c.alias("confidence")).withColumn("tier", tier)


def gaps(nodes: DataFrame, edges: DataFrame, label: str, type: str) -> DataFrame:
    """Nodes of a label without an edge of a type on either side."""
    touched = edges.filter(F.col("type") == type)
    own = nodes.filter(F.col("label") == label)
    return own.join(touched.select(F.col("to_id").alias("node_id")), "node_id", "left_anti").join(touched.select(F.col("from_id").alias("node_id")), "node_id", "left_anti").select("node_id")


def resolve(names: DataFrame) -> DataFrame:
    """Names (node_id, name) grouped by their canonical key: the key, its smallest id, and how many."""
    from ..functions.text import entity_key

    return names.groupBy(entity_key(F.col("name")).alias("entity_key")).agg(F.min("node_id").alias("node_id"), F.count("*").alias("n"))
