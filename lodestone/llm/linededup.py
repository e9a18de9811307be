"""Lines that many documents repeat, found through a sharded minimal perfect hash over the distinct line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; keys shorter than `least_chars` code points are left alone. Each
document sends the 128-bit hash of each of its keys once; counting them by hash (partial aggregates first, so a line of every document is no
hot key) leaves the lines of at least two documents, since no other can be a repetition. These are dealt by hash to shards of some 250,000.
A shard is one row of arrays: a minimal perfect hash, and in its order a 64-bit fingerprint, the number of documents, and the largest doc_id.

The hash goes by levels of bits, two for each key left: a key alone on its bit is placed there, those that meet go on to the next level; the
place of a key is the rank of its bit. Any other key ends on some bit too, or on none, and is told apart by its fingerprint (a chance of
2^-64). Documents look their lines up in the arrays and are put together again in the same pass: while all arrays have at most `held` bytes, each
worker reads them from the shared folder once and the texts are not shuffled. Beyond that the hashes go to the shards, in groups of bounded size,
and the dropped ones come back to their documents by a join. Both give the same rows. The folder is opened by path with pyarrow's file systems.

A null text is one empty line, as an empty one is. Rows that repeat a doc_id count as documents of their own, and all rows with the largest
keep their lines; a null doc_id is smaller than all others. Line ends are \\n alone. An empty table gives no rows. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, mix64, small_or_not, stored
from .tokens import worker_store

WHITE = " \t\n\x0b\x0c\r"
SHARD, HELD, GROUP = 1 << 18, 64 << 20, 1 << 20  # keys of a shard, bytes of arrays a worker holds, hashes looked up in one group
U64 = np.dtype("<u8")


class PerfectHash:
    """Minimal perfect hash of distinct pairs of unsigned 64-bit integers."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # the bit at which a level begins
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _bit(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a ^ mix64(b, 2 * level), 2 * level + 1) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        sizes, words = [], []
        while len(a):
            size = -(-2 * len(a) // 64) * 64
            bit = cls._bit(a, b, len(sizes), size)
            alone = np.bincount(bit, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(size)
            left = ~alone[bit]
            a, b = a[left], b[left]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, U64), *words]))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; some place or -1 for a key that is not among those of build()."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, size in enumerate(self.sizes):
            bit = self.first[level] + self._bit(a[left], b[left], level, int(size))
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            on = (word >> shift & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[left[on]] = self.before[bit[on] >> 6] + below[on]
            left = left[~on]
        return out


def _print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a, 97) ^ b


def _build(key, t):
    a, b = (t[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    hash_ = PerfectHash.build(a, b)
    order = np.argsort(hash_.places(a, b))
    last = t["last"].combine_chunks().take(pa.array(order))
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([hash_.sizes.tobytes()], pa.binary()), "words": pa.array([hash_.words.tobytes()], pa.binary()),
        "prints": pa.array([_print(a, b)[order].tobytes()], pa.binary()), "counts": pa.array([t["n"].to_numpy()[order].astype("<u4").tobytes()], pa.binary()),
        "last": pa.ListArray.from_arrays([0, len(last)], last),
    })


class Shard:
    """The arrays of a row made by _build."""

    def __init__(self, sizes: bytes, words: bytes, prints: bytes, counts: bytes, last: pa.Array):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(words, U64))
        self.prints, self.counts, self.last = np.frombuffer(prints, U64), np.frombuffer(counts, "<u4"), last

    @classmethod
    def of(cls, t, i: int) -> "Shard":
        return cls(*(t.column(c)[i].as_py() for c in ("sizes", "words", "prints", "counts")), t.column("last")[i].values)

    def drops(self, a: np.ndarray, b: np.ndarray, ids: pa.Array, least: int) -> np.ndarray:
        """Whether the document of this id loses the line of this hash."""
        at = self.hash.places(a, b)
        out = (at >= 0) & (self.prints[at] == _print(a, b)) & (self.counts[at] >= least)
        hit = np.flatnonzero(out)
        same = pc.fill_null(pc.equal(self.last.take(pa.array(at[hit])), ids.take(pa.array(hit))), False).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(self.last.take(pa.array(at[hit]))), pc.is_null(ids.take(pa.array(hit)))).to_numpy(zero_copy_only=False)
        out[hit] = ~(same | both)
        return out


def _split(text: str | None, least_chars: int) -> tuple[list[str], list[int], list[bytes]]:
    """The lines of a text, and number and hash of those whose key is long enough."""
    lines, at, hashes = (text or "").split("\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= least_chars:
            line = line.strip(WHITE)
            if len(line) >= least_chars:
                at.append(i)
                hashes.append(hashlib.blake2b(line.encode().lower(), digest_size=16).digest())  # bytes: A-Z alone are lower-cased
    return lines, at, hashes


def _pairs(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(hashes), U64).reshape(-1, 2)
    return flat[:, 0].copy(), flat[:, 1].copy()


def _hashes(least_chars: int):
    """Of (doc_id, ..., text): all but the text, and a, b for each distinct key of the row."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                each = [list(dict.fromkeys(_split(t, least_chars)[2])) for t in some.column(some.num_columns - 1).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
                a, b = _pairs([h for e in each for h in e])
                kept = [some.column(i).take(row) for i in range(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], [*some.schema.names[:-1], "a", "b"])

    return run


def _without(some: pa.RecordBatch, split: list, gone: list[set[int]]) -> pa.RecordBatch:
    texts = ["\n".join([x for i, x in enumerate(lines) if i not in g]) if g else "\n".join(lines) for (lines, _, _), g in zip(split, gone)]
    return pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s[0]) for s in split], pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def _read(files: list[str]) -> dict[int, Shard]:
    """The shards in these files, read once by a worker."""
    held = worker_store("line-shards")
    if held.get("files") != files:
        held.clear()
        tables = [pq.read_table(path, filesystem=fs) for fs, path in (pafs.FileSystem.from_uri(f) for f in files)]
        held["shards"] = {t["shard"][i].as_py(): Shard.of(t, i) for t in (x.combine_chunks() for x in tables) for i in range(len(t))}
        held["files"] = files
    return held["shards"]


def _probe(files: list[str], n_shards: int, least: int, least_chars: int):
    """Of (doc_id, text): doc_id, n_lines, n_dropped, text."""

    def run(batches):
        shards = _read(files)
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                split = [_split(t, least_chars) for t in some.column(1).to_pylist()]
                doc = np.repeat(np.arange(len(split)), [len(s[1]) for s in split])
                line = np.array([i for s in split for i in s[1]], np.int64)
                a, b = _pairs([h for s in split for h in s[2]])
                part, gone = (a >> np.uint64(1)) % np.uint64(n_shards), [set() for _ in split]
                for p in np.unique(part):
                    mine = np.flatnonzero(part == p)
                    if int(p) in shards:
                        mine = mine[shards[int(p)].drops(a[mine], b[mine], some.column(0).take(pa.array(doc[mine])), least)]
                        for d, i in zip(doc[mine].tolist(), line[mine].tolist()):
                            gone[d].add(i)
                yield _without(some, split, gone)

    return run


def _probe_group(least: int):
    """Of a shard and a group of (doc_id, text_hash, a, b): those that are dropped."""

    def run(key, shard, asked):
        asked = asked.select(["doc_id", "text_hash", "a", "b"]).combine_chunks()
        if not len(shard) or not len(asked):
            return asked.slice(0, 0)
        a, b = (asked[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        return asked.filter(pa.array(Shard.of(shard, 0).drops(a, b, asked["doc_id"].combine_chunks(), least)))

    return run


def _drop_listed(least_chars: int):
    """Of (doc_id, text, hashes): the lines without those of the hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                split = [_split(t, least_chars) for t in some.column(1).to_pylist()]
                listed = [{x["a"].to_bytes(8, "little", signed=True) + x["b"].to_bytes(8, "little", signed=True) for x in h or ()} for h in some.column(2).to_pylist()]
                yield _without(some, split, [{i for i, h in zip(s[1], s[2]) if h in g} for s, g in zip(split, listed)])

    return run


def arrays(docs: DataFrame, least_chars: int = 40) -> tuple[DataFrame, int]:
    """The stored shards (shard, sizes, words, prints, counts, last) over the lines of at least two documents, and how many shards there are."""
    kind = dict(docs.dtypes)["doc_id"]
    each = docs.select("doc_id", "text").mapInArrow(_hashes(least_chars), f"doc_id {kind}, a long, b long")
    lines = stored(each.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter("n > 1"), "lines")
    shards = max(1, -(-lines.count() // SHARD))
    schema = f"shard long, sizes binary, words binary, prints binary, counts binary, last array<{kind}>"
    out = stored(lines.withColumn("shard", F.shiftrightunsigned("a", 1) % shards).groupBy("shard").applyInArrow(_build, schema), "line-arrays")
    drop_stored(lines)
    return out, shards


def drop_repeated(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, held: int = HELD) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: each document without the lines that at least `least_docs` (2 or more) documents hold, of which the one
    with the largest doc_id keeps them. The table is stored."""
    if least_docs < 2:
        raise ValueError("least_docs must be at least 2")
    kind = dict(docs.dtypes)["doc_id"]
    shards, n = arrays(docs, least_chars)
    size = sum(F.octet_length(c) for c in ("sizes", "words", "prints", "counts")) + 16 * F.size("last") + (F.octet_length(F.array_join(F.col("last").cast("array<string>"), "")) if kind == "string" else F.lit(0))
    schema = f"doc_id {kind}, n_lines long, n_dropped long, text string"
    if (shards.agg(F.sum(size).alias("s")).first()["s"] or 0) <= held:
        out = stored(docs.select("doc_id", "text").mapInArrow(_probe(sorted(shards.inputFiles()), n, least_docs, least_chars), schema), "lines-dropped")
        drop_stored(shards)
        return out
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    asked = hashed.mapInArrow(_hashes(least_chars), f"doc_id {kind}, text_hash long, a long, b long")
    asked = stored(asked.withColumn("shard", F.shiftrightunsigned("a", 1) % n), "lines-asked")
    groups = stored(asked.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "line-groups")
    dealt = asked.join(small_or_not(groups, 1_000_000), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("groups")))
    met = shards.join(groups, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    gone = met.select("shard", "part", "sizes", "words", "prints", "counts", "last").groupBy("shard", "part").cogroup(dealt.select("shard", "part", "doc_id", "text_hash", "a", "b").groupBy("shard", "part"))
    gone = gone.applyInArrow(_probe_group(least_docs), f"doc_id {kind}, text_hash long, a long, b long")
    gone = gone.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_set(F.struct("a", "b")).alias("hashes"))
    joined = hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["of_id"]) & (hashed["text_hash"] == gone["of_hash"]), "left")
    out = stored(joined.select("doc_id", "text", "hashes").mapInArrow(_drop_listed(least_chars), schema), "lines-dropped")
    drop_stored(shards, asked, groups)
    return out
