"""Near-duplicate classes: fast similarity sketches, banding, exact verification, connected components.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of `width` words
as 64-bit hashes (with fewer words, the whole sequence as one). Documents of equal sets are one class and go on as their smallest
doc_id.

The sketch has 160 coordinates. In round r each element is thrown into one bin by a hash of its own and writes r and a hash; a
bin keeps the smallest it has seen, so later rounds fill only bins still empty. Rounds beyond the 160th throw every element into
one bin each, so 320 rounds fill every coordinate, whatever the set. Coordinates agree with the probability of the Jaccard
similarity. 32 bands of 5 coordinates meet for a pair of similarity 0.8 but for a chance of 3e-6.

Candidates come in two steps. First the members of all buckets, one for each class, are dealt by ranges of (bucket, class), so that a
bucket of any size is spread evenly; each is compared with the first of its bucket in its task, and the first ones of a bucket that spans
tasks are compared with the very first: as many pairs as members. Confirmed links make components. Then only buckets that still hold
more than one component are taken up. There a member can have a partner in another component only if it lies within 62 + r of that
component's leader, r being the farthest of the component's members from it in that bucket; distance is the number of
sketch places (8 bits a coordinate) that differ, a metric, so this drops nothing. Two groups of near copies in one bucket thus cost
members times components, not members squared. Among the members that are left all pairs between different components are looked
at, in blocks, within a task that emits only those whose sketches agree in 98 of 160 places (a linked pair falls short with a chance below
1e-8) and whose set sizes allow the link. No candidate is dropped. Every link counts only after the full sets were intersected:
100 * common >= 80 * union. Members without a close partner that share a bucket all the same (unrelated documents with one long
common passage) are each a component, and there the work does grow with the square of their number, in numpy and in blocks.

Result: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept. Links are between texts: rows that share a doc_id
but not the text are documents of their own, and each row gets the component of its text. Null or empty texts, and texts of white space,
have no shingles and link to nothing. A null doc_id joins the component of its text but names none and is never kept; component_id is null
where no member has an id. doc_id may be of any type that can be ordered. An empty table gives no rows. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, mix64, plain_names, small_or_not, stored

COORDINATES, BANDS, ROWS = 160, 32, 5
AGREE = 98
BLOCK = 500  # members or leaders of a bucket that one group holds
SHINGLES = 8_000_000  # about so many shingles of 8 bytes one side of a group holds; more go to further blocks
IDS = 1_000_000  # at most so many ids (16 bytes each) are broadcast to pick documents; more are joined by a shuffle
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, as is split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) == 0:
        return h
    out = mix64(h[: max(1, len(h) - width + 1)], 0)
    for i in range(1, min(width, len(h))):
        out = mix64(out ^ h[i : len(out) + i], i)
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES values for each set, none of which may be empty."""
    t = COORDINATES
    flat = np.full(len(sets) * t, FULL)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for r in range(2 * t):
        h = mix64(x, r + 1)
        bins = ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if r < t else r - t
        np.minimum.at(flat, owner * t + bins, (np.uint64(r) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (flat.reshape(-1, t) == FULL).any(axis=1)
        if not open_.any():
            break
        go = open_[owner]
        owner, x = owner[go], x[go]
    return flat.reshape(-1, t)


def _sign(width: int):
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.slice(at, 128)
                sets = [shingles(t, width) for t in part.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                s = sketches([sets[i] for i in full])
                keys = np.zeros((len(full), BANDS), dtype=np.uint64)
                for i in range(BANDS):
                    k = np.full(len(full), i, dtype=np.uint64)
                    for j in range(ROWS):
                        k = mix64(k ^ s[:, i * ROWS + j], j)
                    keys[:, i] = k
                small = np.hstack([mix64(s, 99).astype(np.uint8), keys.astype("<u4").view(np.uint8)])
                digest, bands, brief = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for row, i in enumerate(full):
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i], brief[i] = keys[row].view(np.int64), small[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "digest", "bands", "brief"],
                )

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["vid", "items"])

    return run


def _items(docs: DataFrame, own: DataFrame, vids: DataFrame, width: int, repeated: bool) -> DataFrame:
    """The full sets (vid, items) of some classes, from one text of each."""
    asked = stored(own.select("vid", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).join(small_or_not(vids, IDS), "vid", "left_semi"), "neardup-asked")
    rows = docs.join(small_or_not(asked, IDS), docs["doc_id"].eqNullSafe(F.col("of_id")) & (docs["text_hash"] == F.col("of_hash"))).select("vid", "text")
    rows = rows.dropDuplicates(["vid"]) if repeated else rows
    sets = stored(rows.mapInArrow(_sets(width), "vid long, items array<long>"), "neardup-sets")
    drop_stored(asked)
    return sets


def _stars(percent: int):
    """Of rows (key, vid, n) sorted by key and vid: each with the first of its bucket here, and (border) the first of a bucket that may go on
    in another task. Of both the bucket; a bucket of one member that lies within a task leaves nothing."""
    names = ["key", "vid", "hub", "border"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches):
        hub, size, first, held, count = None, 0, True, [], 0
        # members seen are held back until the bucket turns out to have a second one
        for b in batches:
            for key, vid, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if hub is None or key != hub[0]:
                    first = hub is None
                    hub, size = (key, vid, n), 1
                    held_hub = (key, vid, None, first)
                    if first:
                        held.append(held_hub)
                else:
                    size += 1
                    if size == 2 and not first:
                        held.append(held_hub)
                    close = 100 * min(n, hub[2]) >= percent * max(n, hub[2])
                    held.append((key, vid, hub[1] if close else None, False))
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                    held = []
        if hub is not None:  # the last bucket may go on
            held.append((hub[0], hub[1], None, True))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return run


def _spread(many: DataFrame, few: DataFrame, key: str, by, counted: DataFrame | None = None) -> DataFrame:
    """many joined with few, which has a row for each key at most. A key with more than BLOCK rows meets its row in blocks; `by` deals them out and must
    be the same whenever a row is computed again. `counted` has the keys of many, if it is cheaper to read."""
    counts = many if counted is None else counted
    hot = small_or_not(stored(counts.groupBy(key).agg(_blocks_of("count(1)").alias("blocks")).filter("blocks > 1"), "neardup-hot"), IDS)
    many = many.withColumn("dealt", by).join(hot, key, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("dealt"), F.col("blocks")).cast("int"), F.lit(0))).drop("dealt", "blocks")
    few = few.join(hot, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return many.join(few, [key, "block"]).drop("block")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar enough. The first of a large bucket has as many pairs as the bucket has members."""
    left, right = (sets.select(F.col("vid").alias(x), F.col("items").alias(f"of_{x}")) for x in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = _spread(pairs.join(right, "b"), left, "a", F.col("b"), pairs).select("a", "b", common.alias("c"), (F.size("of_a") + F.size("of_b")).alias("n"))
    return stored(both.filter(F.expr(f"100 * c >= {percent} * (n - c)")).select("a", "b").distinct(), "neardup-links")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in edges (a, b), by alternating large and small stars. A node of many
    edges meets its smallest neighbour in blocks of them."""
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(_spread(both, low, "u", F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, low, "u", F.col("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stored(small.filter("u <> v").distinct(), "stars")
        mark = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_stored(cur, large)
        cur = new
        if mark == before:
            break
        before = mark
    stars = cur.groupBy("u").agg(F.min("v").alias("m"))
    out = stored(stars.select(F.col("u").alias("id"), F.col("m").alias("component")).union(stars.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()), "components")
    drop_stored(cur)
    return out


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which the sketches differ."""
    return (a != b).sum(axis=-1)


def _leaders(batches):
    """Of rows (key, block, comp, vid, brief) sorted by the first four: for each component in each block of a bucket its first member's sketch,
    and how far the others lie from it."""
    held, lead, far = None, None, 0
    out: list[tuple] = []
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "comp", "vid", "brief", "far"])

    for b in batches:
        for key, block, comp, vid, brief in zip(*(b.column(i).to_pylist() for i in range(5))):
            sketch = np.frombuffer(brief, np.uint8, COORDINATES)
            if held is None or (key, block, comp) != held[:3]:
                if held:
                    out.append((held[0], held[2], held[3], lead.tobytes(), far))
                held, lead, far = (key, block, comp, vid), sketch, 0
                if len(out) >= 10_000:
                    yield batch()
                    out = []
            else:
                far = max(far, int(_gap(lead, sketch)))
    if held:
        out.append((held[0], held[2], held[3], lead.tobytes(), far))
        yield batch()


def _joined_leaders(batches):
    """Of rows (key, comp, vid, brief, far), the leaders of blocks, sorted by the first three: for each component of a bucket the first, and
    how far any member can lie from it."""
    held, lead, far = None, None, 0
    out: list[tuple] = []
    for b in batches:
        for key, comp, _, brief, own in zip(*(b.column(i).to_pylist() for i in range(5))):
            sketch = np.frombuffer(brief, np.uint8)
            if (key, comp) != held:
                if held:
                    out.append((*held, lead.tobytes(), far))
                held, lead, far = (key, comp), sketch, own
            else:
                far = max(far, int(_gap(lead, sketch)) + own)
    if held:
        out.append((*held, lead.tobytes(), far))
    for at in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000]), (pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["key", "comp", "brief", "far"])


def _in_reach(batches):
    """Of rows (key, mine, theirs, far, comp, vid, brief) sorted by the first four, the leaders (far >= 0) of some components of a bucket and some
    members (far null, sorted first): (key, vid) of the members within reach of a leader of another component."""

    def found(g):
        lead = [r for r in g if r[0] is not None]
        own = [r for r in g if r[0] is None]
        if not lead or not own:
            return []
        sketch = np.frombuffer(b"".join(r[3] for r in lead), np.uint8).reshape(len(lead), -1)
        reach, comps = np.array([r[0] for r in lead]) + COORDINATES - AGREE, np.array([r[1] for r in lead])
        return [r[2] for r in own if ((comps != r[1]) & (_gap(sketch, np.frombuffer(r[3], np.uint8, COORDINATES)) <= reach)).any()]

    held, group = None, []
    for b in batches:
        out = []
        for key, mine, theirs, far, comp, vid, brief in zip(*(b.column(i).to_pylist() for i in range(7))):
            if (key, mine, theirs) != held:
                out += [(held[0], v) for v in found(group)] if held else []
                held, group = (key, mine, theirs), []
            group.append((far, comp, vid, brief))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "vid"])
    if held and (out := [(held[0], v) for v in found(group)]):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "vid"])


def _blocks_of(size: str):
    return F.expr(f"cast(ceil({size} / {BLOCK}) as int)")


def _blocks_with_sets():
    """By members and by the sum of their set sizes, so that a task which confirms links holds a bounded number of bytes."""
    return F.expr(f"cast(ceil(greatest(count(1) / {BLOCK}, sum(n) / {SHINGLES})) as int)")


def _place(blocks: str):
    return F.pmod(F.xxhash64("vid"), F.col(blocks)).cast("int")


def _near_others(rows: DataFrame) -> DataFrame:
    """Of members (key, band, vid, n, comp, brief) of mixed buckets those that can have a partner in another component there."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = small_or_not(stored(rows.groupBy("key").agg(_blocks_of("count(1)").alias("blocks")).filter("blocks > 1"), "neardup-sizes"), IDS)
    rows = rows.join(sizes, "key", "left").withColumn("mine", F.coalesce(_place("blocks"), F.lit(0))).fillna(1, ["blocks"])
    of_block = rows.select("key", F.col("mine").cast("long").alias("block"), "comp", "vid", "brief").repartition(parts, "key", "block").sortWithinPartitions("key", "block", "comp", "vid")
    lead = of_block.mapInArrow(_leaders, "key long, comp long, vid long, brief binary, far int")
    lead = stored(lead.repartition(parts, "key", "comp").sortWithinPartitions("key", "comp", "vid").mapInArrow(_joined_leaders, "key long, comp long, brief binary, far int"), "neardup-leaders")
    many = small_or_not(stored(lead.groupBy("key").agg(_blocks_of("count(1)").alias("sides")).filter("sides > 1"), "neardup-sides"), IDS)
    members = rows.join(many, "key", "left").select("key", "mine", F.explode(F.sequence(F.lit(0), F.coalesce("sides", F.lit(1)) - 1)).alias("theirs"), F.lit(None).cast("int").alias("far"), "comp", "vid", "brief")
    leaders = lead.withColumn("vid", F.col("comp")).join(many, "key", "left").join(sizes, "key", "left").withColumn("theirs", F.coalesce(_place("sides"), F.lit(0)))
    leaders = leaders.select("key", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("mine"), "theirs", "far", "comp", "vid", "brief")
    met = members.unionByName(leaders).repartition(parts, "key", "mine", "theirs").sortWithinPartitions("key", "mine", "theirs", F.col("far").asc_nulls_first())
    live = met.mapInArrow(_in_reach, "key long, vid long").distinct()
    return rows.drop("blocks", "mine").join(live, ["key", "vid"])


def _candidates(g: dict, percent: int):
    """(member, its possible partners) of one block pair of one bucket: other component, size and sketch allow it, no earlier band shared."""
    comp, n, block, band = g["comp"], g["n"], g["block"], g["band"][0]
    both = np.frombuffer(b"".join(g["brief"]), dtype=np.uint8).reshape(len(comp), COORDINATES + 4 * BANDS)
    brief, bands = both[:, :COORDINATES], np.ascontiguousarray(both[:, COORDINATES:]).view("<u4")[:, :band]
    same = g["lo"] == g["hi"]
    left, right = np.flatnonzero(block == g["lo"]), np.flatnonzero(block == g["hi"])
    for i in left:
        r = right[right > i] if same else right
        r = r[(comp[r] != comp[i]) & (100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i]))]
        if len(r):
            r = r[(brief[r] == brief[i]).sum(axis=1) >= AGREE]
        if len(r):
            r = r[~(bands[r] == bands[i]).any(axis=1)]
        if len(r):
            yield i, r


COLUMNS = ("key", "lo", "hi", "vid", "n", "comp", "block", "band", "brief")
GROUP = "key long, lo int, hi int, vid long, n long, comp long, block int, band int, brief binary"


def _groups(batches, more: tuple[str, ...] = ()):
    """The rows of each (key, lo, hi), out of rows sorted by them."""
    names = ("vid", "n", "comp", "block", "band")
    held, last = None, None

    def made():
        return {x: np.array(held[x]) for x in names} | {x: held[x] for x in ("brief", *more)} | dict(zip(("key", "lo", "hi"), last))

    for b in batches:
        d = {x: b.column(x).to_pylist() for x in COLUMNS} | {x: [v.values.to_numpy() for v in b.column(x)] for x in more}
        for i, k in enumerate(zip(d["key"], d["lo"], d["hi"])):
            if k != last:
                if held and len(held["vid"]) > 1:
                    yield made()
                held, last = {x: [] for x in (*names, "brief", *more)}, k
            for x in held:
                held[x].append(d[x][i])
    if held and len(held["vid"]) > 1:
        yield made()


def _live(percent: int):
    """The rows that have a possible partner."""

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        out: list[tuple] = []
        for g in _groups(batches):
            at = sorted({int(x) for i, r in _candidates(g, percent) for x in (i, *r)})
            out += [(g["key"], g["lo"], g["hi"], g["vid"][i], g["n"][i], g["comp"][i], g["block"][i], g["band"][i], g["brief"][i]) for i in at]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(COLUMNS))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(COLUMNS))

    return run


def _linked(percent: int):
    """Confirmed links between components, at most one for each two that meet in a bucket."""

    def run(batches):
        for g in _groups(batches, ("items",)):
            root: dict[int, int] = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            out = []
            for i, r in _candidates(g, percent):
                for j in r:
                    a, b = find(g["comp"][i]), find(g["comp"][j])
                    if a == b:
                        continue
                    common = len(np.intersect1d(g["items"][i], g["items"][j], assume_unique=True))
                    if 100 * common >= percent * (len(g["items"][i]) + len(g["items"][j]) - common):
                        root[max(a, b)] = min(a, b)
                        out.append(sorted((int(g["vid"][i]), int(g["vid"][j]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _named(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """The signed rows (doc_id, text_hash, n_shingles, digest), their classes (digest, component, with the smallest doc_id of the class and a text
    of it), both stored, and whether rows repeat id and text."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = stored(docs.mapInArrow(_sign(width), f"doc_id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>, brief binary"), "neardup-signed")
    repeated = not signed.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    # one row stands for the class: ids first, then the smallest
    first = F.min_by(F.struct("doc_id", "text_hash", F.col("n_shingles").alias("n"), "bands", "brief"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    own = signed.filter("digest is not null").groupBy("digest").agg(first.alias("x")).select("digest", "x.*")
    own = stored(own.withColumn("vid", F.monotonically_increasing_id()), "neardup-own")

    # buckets of more than one member, and a star in each
    members = own.select(F.posexplode("bands").alias("band", "key"), "vid", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("key", "vid", "n").repartitionByRange(parts, "key", "vid").sortWithinPartitions("key", "vid")
    crowd = stored(dealt.mapInArrow(_stars(percent), "key long, vid long, hub long, border boolean"), "neardup-crowd")
    border = crowd.filter("border")  # two rows a task at most
    more = border.groupBy("key").agg(F.min("vid").alias("hub"), F.collect_set("vid").alias("vids")).select("hub", F.explode("vids").alias("vid")).filter("vid <> hub")
    sizes = own.select("vid", "n")
    more = more.join(sizes, "vid").join(sizes.select(F.col("vid").alias("hub"), F.col("n").alias("m")), "hub").filter(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = crowd.filter("hub is not null").select(F.col("hub").alias("a"), F.col("vid").alias("b")).union(more.select(F.col("hub"), F.col("vid"))).distinct()
    pairs = stored(pairs, "neardup-pairs")
    sets = _items(docs, own, stored(pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct(), "neardup-ids"), width, repeated)
    links = _confirmed(pairs, sets, percent)
    drop_stored(sets, pairs)
    last = components(links)

    labelled = crowd.select("key", "vid").distinct().join(last.withColumnRenamed("id", "vid"), "vid", "left").select("key", "vid", F.coalesce("component", "vid").alias("comp"))
    labelled = stored(labelled, "neardup-labelled")
    mixed = stored(labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key"), "neardup-mixed")
    rows = labelled.join(small_or_not(mixed, IDS), "key", "left_semi").join(own.select("vid", "n", "brief", "bands"), "vid")
    rows = stored(rows.select("key", (F.array_position("bands", F.col("key")) - 1).cast("int").alias("band"), "vid", "n", "comp", "brief"), "neardup-rows")
    rows = stored(_near_others(rows), "neardup-near")
    blocks = small_or_not(stored(rows.groupBy("key").agg(_blocks_with_sets().alias("blocks")).filter("blocks > 1"), "neardup-blocks"), IDS)
    rows = rows.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", _place("blocks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).select(*COLUMNS)
    # by ranges: tasks get like numbers of rows, where a hash may send several full block pairs to one
    pairs_of = rows.repartitionByRange(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "vid")
    live = stored(pairs_of.mapInArrow(_live(percent), GROUP), "neardup-live")
    if not live.isEmpty():
        sets = _items(docs, own, stored(live.select("vid").distinct(), "neardup-ids"), width, repeated)
        # stored, so that sampling the ranges does not join twice; by ranges for the same reason as above
        full = stored(live.join(sets, "vid").select(*COLUMNS, "items"), "neardup-full")
        dealt = full.repartitionByRange(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "vid")
        last = components(links.union(dealt.mapInArrow(_linked(percent), "a long, b long").distinct()))
        drop_stored(sets, full)
    named = own.join(last.withColumnRenamed("id", "vid"), "vid", "left").select("digest", F.coalesce("component", "vid").alias("component"), "doc_id", "text_hash")
    named = stored(named, "neardup-named")
    out = stored(signed.select("doc_id", "text_hash", "n_shingles", "digest"), "neardup-rows")
    drop_stored(signed, own, crowd, links, labelled, mixed, live)
    return out, named, repeated


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    signed, named, _ = _named(docs, width, percent)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = _spread(named.select("digest", "component"), smallest, "component", F.col("digest")).select("digest", "component_id")
    # signed is a stored table, read alike each time: its row numbers deal out equal rows too
    some = _spread(signed.filter("digest is not null"), named, "digest", F.monotonically_increasing_id()).select("doc_id", "n_shingles", "component_id")
    none = signed.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(some.union(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "neardup")
    drop_stored(signed)
    return out


@plain_names
def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component, with all its columns: the one of the smallest doc_id (null last), then digest of its shingles. Rows
    that share a doc_id are told apart by their texts, so none is lost that has no copy elsewhere. Rows without words are linked to nothing and
    stay; but of rows that repeat doc_id and text one stays, that of the smallest hash of all its columns."""
    signed, named, repeated = _named(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "text_hash")
    best = named.groupBy("component").agg(F.min(order).alias("b")).select("b.doc_id", "b.digest", "b.text_hash")
    rows = signed.filter("digest is not null").select("doc_id", "text_hash", "digest")
    same = [rows[c].eqNullSafe(best[c]) for c in ("doc_id", "digest", "text_hash")]
    gone = rows.join(best, same[0] & same[1] & same[2], "left_anti").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).distinct()
    gone = small_or_not(stored(gone, "neardup-gone"), IDS)
    h = fresh("text_hash", docs.columns)
    hashed = docs.withColumn(h, F.xxhash64("text"))
    left = hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["of_id"]) & (hashed[h] == gone["of_hash"]), "left_anti")
    if repeated:
        again = signed.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
        again = small_or_not(stored(again, "neardup-again"), IDS)
        match = left["doc_id"].eqNullSafe(again["of_id"]) & (left[h] == again["of_hash"])
        same = left.join(again, match, "left_semi")
        first = F.xxhash64(F.to_json(F.struct(*docs.columns)))
        one = same.groupBy(F.col("doc_id").alias("of_id"), F.col(h).alias("of_hash")).agg(F.min_by(F.struct(*left.columns), first).alias("one")).select("one.*")
        left = left.join(again, match, "left_anti").union(one)
    return left.drop(h)
