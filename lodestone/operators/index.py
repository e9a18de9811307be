"""The search index as tables: postings with positions, document frequencies with idf, and norms; derived on the fly or kept in a folder.

corpus: id, type, text, and if there metadata (a map). postings: id, segment, token, n, tf (share of the document's tokens), n_tokens, positions. idf =
ln(max(N, 1) / (df + 1)) + 1 with N the documents that have at least one token. Everything is a partial aggregate followed by one shuffle
on its key.
"""

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import tokenize
from ..sources.store import drop_stored, small_or_not, stored
from ..sources.versions import Versions

SEGMENTS, SHARE = 16, 0.2  # changes, and their share of the documents, beyond which a store is merged by the change, and by what reads it again
BLOCKS = 1000  # of the postings at most, each of documents of like length
ROW_GROUP, PAGE = 1 << 20, 2048  # bytes of a group and rows of a page: what a search can skip
IDS = 1_000_000  # ids of a change, documents and tokens up to which they are broadcast
POSTINGS = 1_000_000  # of a part that is sorted, four times as many at most, so that it fits memory, and of a task's rows that are packed at once
PARTS = 200  # beyond which parts become larger
HELD = 4_000_000  # documents whose ranges are broadcast at once where ids are numbers, a quarter of that where they are not: the driver holds them all


@dataclass(frozen=True)
class Index:
    """entries: id, segment, type, metadata, token_count, unique_tokens, indexed_at, words (token, n), and norm if it is up to date; postings;
    vocabulary: token, df, idf. Postings whose (id, segment) is not among the entries are dead. bounds: token, block, most, n, where postings
    also have type, block and impact (tf * idf / norm); None where the postings are not ranked."""

    entries: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    bounds: DataFrame | None = None

    def with_norms(self, found: DataFrame) -> DataFrame:
        """Rows (id, segment, ...) of live documents with their norms: those kept, or where documents changed since, made of the words of the ids found."""
        if "norm" in self.entries.columns:
            return found.join(self.entries.select("id", "segment", "norm"), ["id", "segment"])
        own = self.entries.select("id", "segment", "words").join(found.select("id", "segment").distinct(), ["id", "segment"], "left_semi")
        each = own.select("id", "segment", F.explode("words").alias("w"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("n_tokens"))
        weighted = each.select("id", "segment", F.col("w.token").alias("token"), (F.col("w.n") / F.col("n_tokens")).alias("tf")).join(self.vocabulary, "token")
        w = F.col("tf") * F.col("idf")
        n = F.sqrt(F.sum(w * w))
        return found.join(weighted.groupBy("id", "segment").agg(F.when(n == 0, 1.0).otherwise(n).alias("norm")), ["id", "segment"])


def postings(corpus: DataFrame) -> DataFrame:
    tokens = corpus.select("id", tokenize(F.col("text")).alias("tokens"))
    each = tokens.select("id", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("at", "token"))
    counted = each.groupBy("id", "n_tokens", "token").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("at")).alias("positions"))
    return counted.select("id", "token", "n", (F.col("n") / F.col("n_tokens")).alias("tf"), "n_tokens", "positions")


def token_stats(corpus: DataFrame) -> DataFrame:
    t = tokenize(F.col("text"))
    return corpus.select("id", F.size(t).alias("token_count"), F.size(F.array_distinct(t)).alias("unique_tokens"))


def corpus_size(corpus: DataFrame) -> DataFrame:
    """One row: the documents with at least one token."""
    return corpus.filter(F.lower("text").rlike("[a-z0-9]")).agg(F.greatest(F.count("*"), F.lit(1)).alias("docs"))


def idf(posts: DataFrame, size: DataFrame) -> DataFrame:
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(size)).select("token", "df", (F.log(F.col("docs") / (F.col("df") + 1)) + 1).alias("idf"))  # size is one row


def norms(posts: DataFrame, weights: DataFrame) -> DataFrame:
    w = F.col("tf") * F.col("idf")
    n = F.sqrt(F.sum(w * w))
    return posts.join(weights, "token").groupBy("id").agg(F.when(n == 0, 1.0).otherwise(n).alias("norm"))


def top_terms(weights: DataFrame, n: int = 20) -> DataFrame:
    return weights.select("token", F.round("idf", 4).alias("idf")).orderBy(F.desc("idf"), "token").limit(n)


def _entries(corpus: DataFrame, at) -> DataFrame:
    t = tokenize(F.col("text"))
    meta = F.col("metadata") if "metadata" in corpus.columns else F.expr("map()").cast("map<string,string>")
    return corpus.select("id", "type", meta.alias("metadata"), F.size(t).alias("token_count"), F.size(F.array_distinct(t)).alias("unique_tokens"), at.alias("indexed_at"))


def _words(posts: DataFrame) -> DataFrame:
    return posts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("words"))


def _counted(corpus: DataFrame) -> DataFrame:
    """id, type, metadata, content (a hash), token_count and words (token, n, positions) in the order of tokens. A document is counted in its own row, many of a
    batch at once, so nothing is shuffled and no group of tokens is held."""
    meta = F.col("metadata") if "metadata" in corpus.columns else F.expr("map()").cast("map<string,string>")
    rows = corpus.select("id", "type", meta.alias("metadata"), F.xxhash64("type", "text").alias("content"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    kept = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
    blank = bytes(c if c in kept else 32 for c in range(256))

    def run(batches):
        for b in batches:
            for low in range(0, len(b), 512):
                some = b.slice(low, 512)
                each = [t.encode().translate(blank).split() for t in some.column(4).to_pylist()]
                sizes = np.array([len(t) for t in each], np.int64)
                coded = pa.array([t for own in each for t in own], pa.binary()).dictionary_encode()
                names = coded.dictionary.to_pylist()
                order = sorted(range(len(names)), key=names.__getitem__)
                rank = np.empty(len(names), np.int64)
                rank[order] = np.arange(len(names))
                doc = np.repeat(np.arange(len(each)), sizes)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = doc * len(names) + rank[coded.indices.to_numpy()] if len(doc) else doc
                by = np.argsort(key, kind="stable")
                key = key[by]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                token = pa.array([names[i].decode() for i in order], pa.string()).take(pa.array(key[first] % max(1, len(names))))
                ends = np.append(first, len(key))
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[by], pa.int32()))
                words = pa.StructArray.from_arrays([token, pa.array(np.diff(ends), pa.int64()), positions], ["token", "n", "positions"])
                cuts = np.searchsorted(key[first], np.arange(len(each) + 1) * max(1, len(names)))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words)], ["id", "type", "metadata", "content", "token_count", "words"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "type", "metadata"))
    return rows.mapInArrow(run, f"{kinds}, content long, token_count int, words array<struct<token:string,n:bigint,positions:array<int>>>")


def _one_each(counted: DataFrame) -> DataFrame:
    """Of rows of one id that of the greatest hash; only where ids repeat are rows moved for it."""
    repeated = stored(counted.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    if repeated.isEmpty():
        drop_stored(repeated)
        return counted
    some = small_or_not(repeated, IDS)
    best = counted.join(some, "id", "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("content")))).filter("__n = 1").drop("__n")
    out = stored(counted.join(some, "id", "left_anti").unionByName(best), "counted")
    drop_stored(counted, repeated)
    return out


def _greatest(postings: DataFrame) -> DataFrame:
    """token, block, most, n of postings in the order of token and block, run by run. A run that ends with a file's part goes on in the next one: readers add up.
    most is a bound, rounded up to one of 512 values between powers of 2, of which a column takes a fifth of what it takes of exact ones."""

    def run(batches):
        held = None
        for b in batches:
            token, block, impact = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            if not len(b):
                continue
            coded = token.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (coded[1:] != coded[:-1]) | (block[1:] != block[:-1])]))
            most, n = np.frexp(np.maximum.reduceat(impact, first)), np.diff(np.append(first, len(b)))
            most = np.ldexp(np.ceil(most[0] * 1024) / 1024, most[1])
            runs = pa.RecordBatch.from_arrays([token.take(pa.array(first)), pa.array(block[first]), pa.array(most), pa.array(n, pa.int64())], ["token", "block", "most", "n"])
            if held is not None:
                yield held
            held = runs
        if held is not None:
            yield held

    return postings.select("token", "block", "impact").mapInArrow(run, "token string, block int, most double, n long")


def _frequencies(terms: DataFrame):
    """A function that gives rows with a token its df, of terms (token, df), a stored table. Tokens of one document, most of the vocabulary, are not looked up.
    As many of the others as may be broadcast are, the most frequent ones, so that beyond that only the rows of rare tokens are shuffled."""
    often = terms.filter("df > 1")
    steps = {r["b"]: r["n"] for r in often.groupBy((F.length(F.bin("df")) - 1).alias("b")).agg(F.count("*").alias("n")).collect()}
    least = 1
    while sum(n for b, n in steps.items() if b >= least) > IDS:
        least += 1
    at = 2**least
    head = F.broadcast(often.filter(F.col("df") >= at))
    if at == 2:
        return lambda rows: rows.join(head, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rare = often.filter(F.col("df") < at).hint("merge")

    def run(rows: DataFrame) -> DataFrame:
        return rows.join(head, "token").unionByName(rows.join(head, "token", "left_anti").join(rare, "token", "left").withColumn("df", F.coalesce("df", F.lit(1))))

    return run


def _by_id(table: DataFrame):
    """A function that joins rows with a stored table of one row for each id. Of a table of more than IDS rows ranges of ids are broadcast, one after the other, and
    each meets the rows of its range alone: the rows, which are many more and wider, are not moved."""
    n = table.count()
    if n <= IDS:
        return lambda rows, on="id": rows.join(F.broadcast(table), on)
    cut = stored(table.repartitionByRange(-(-2 * n // max(1, IDS)), "id").withColumn("__part", F.spark_partition_id()), "by-id")
    spans = cut.groupBy("__part").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("__part").collect()

    def run(rows: DataFrame, on="id") -> DataFrame:
        each = [rows.filter(F.col("id").between(F.lit(s["low"]), F.lit(s["high"]))).join(F.broadcast(cut.filter(F.col("__part") == s["__part"]).drop("__part")), on) for s in spans]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    return run


def _too_many(table: DataFrame) -> bool:
    """Whether a stored table has more ids than the driver may hold in all its ranges."""
    return table.count() > (HELD if isinstance(table.schema["id"].dataType, NumericType) else HELD // 4)


def _met(table: DataFrame):
    """_by_id(table), or where it has too many rows for that a function that joins by a shuffle of both."""
    return (lambda rows, on="id": rows.join(table.hint("merge"), on)) if _too_many(table) else _by_id(table)


def _cuts(terms: DataFrame, most: int) -> list[tuple[str, float]]:
    """(token, share of the blocks) where parts of about `most` postings begin, from terms (token, df) in the order of tokens; a token of more is cut between blocks."""

    def run(batches):
        total = 0
        for b in batches:
            df = b.column(1).to_numpy()
            sums = np.cumsum(df) + total
            for i in np.flatnonzero(sums // most > (sums - df) // most):
                steps = -(-int(df[i]) // most)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[int(i)].as_py()] * steps), pa.array([k / steps for k in range(steps)])], ["token", "share"])
            total = int(sums[-1]) if len(sums) else total

    return sorted((r["token"], r["share"]) for r in terms.select("token", "df").mapInArrow(run, "token string, share double").collect())


def _planes(values: np.ndarray) -> pa.Array:
    """Integers of 32 bits byte by byte, the lowest of all first: small ones leave runs of zeros."""
    return pa.array(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel())


def _of_planes(planes: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(planes.to_numpy().reshape(4, -1).T).ravel().view("<i4").astype(np.int64)


def _steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each value is above the one before it, the first of each run of so many above 0."""
    out = np.diff(values, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = values[first]
    return out


def _of_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(steps)])
    return sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)


def _packed(rows: DataFrame, cuts: list[tuple[str, float]], blocks: int, of_id: tuple = (), of_token: tuple = ()) -> DataFrame:
    """part, rows: what a task has of the rows (token, id, block, positions, ...) for a part, as one compressed Arrow row: its tokens with of_token, columns that follow from
    the token, its documents with of_id, which follow from the id, and of each posting, in the order of token and document, what is its own."""
    names, shares, columns = [t for t, _ in cuts], np.array([s for _, s in cuts]), rows.columns
    rest = [c for c in columns if c not in ("token", "id", "positions", *of_id, *of_token)]

    def packed(held):
        t = pa.Table.from_batches(held).combine_chunks()
        column = {c: t.column(c).combine_chunks() for c in columns}
        coded, docs = column["token"].dictionary_encode(), column["id"].dictionary_encode().indices.to_numpy()
        codes, each = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        rank = np.empty(len(each), np.int64)
        rank[sorted(range(len(each)), key=each.__getitem__)] = np.arange(len(each))
        low, high = (np.array([f(names, w) for w in each], np.int64) for f in (bisect_left, bisect_right))
        part, cut = low[codes], np.flatnonzero(low < high)
        share = column["block"].to_numpy() / blocks
        for i in cut:
            own = np.flatnonzero(codes == i)
            part[own] += np.searchsorted(shares[low[i] : high[i]], share[own], "right")
        by = np.lexsort((docs, rank[codes], part))
        part, codes, docs = part[by], codes[by], docs[by]
        firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(firsts, np.append(firsts[1:], len(part))):
            runs = a + np.flatnonzero(np.concatenate([[True], codes[a + 1 : b] != codes[a : b - 1]]))
            counts = np.diff(np.append(runs, b))
            _, seen, doc = np.unique(docs[a:b], return_index=True, return_inverse=True)
            positions = column["positions"].take(pa.array(by[a:b]))
            sizes = np.diff(positions.offsets.to_numpy())
            kinds = {"tokens": (("token", *of_token), by[runs]), "docs": (("id", *of_id), by[a + seen]), "rest": (rest, by[a:b])}
            out = {k: pa.StructArray.from_arrays([column[c].take(pa.array(at)) for c in some], list(some)) for k, (some, at) in kinds.items() if some}
            out |= {"counts": _planes(counts), "doc": _planes(_steps(doc, counts)), "sizes": _planes(sizes), "positions": _planes(_steps(positions.flatten().to_numpy(), sizes))}
            row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in out.values()], list(out))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(row)
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "rows"])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= POSTINGS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return rows.mapInArrow(pack, "part long, rows binary")


def _unpacked(packed: DataFrame, schema) -> DataFrame:
    columns = schema.names

    def run(batches):
        for b in batches:
            for own in b.column(0):
                one = pa.ipc.open_stream(own.as_buffer()).read_next_batch()
                row = {f: v.flatten() for f, v in zip(one.schema.names, one.columns)}
                counts, sizes = _of_planes(row["counts"]), _of_planes(row["sizes"])
                at = {"tokens": np.repeat(np.arange(len(counts)), counts), "docs": _of_steps(_of_planes(row["doc"]), counts)}
                column = {c: row[k].field(c).take(pa.array(i)) for k, i in at.items() for c in (f.name for f in row[k].type)}
                if "rest" in row:
                    column |= {f.name: row["rest"].field(f.name) for f in row["rest"].type}
                positions = _of_steps(_of_planes(row["positions"]), sizes).astype(np.int32)
                column["positions"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(positions))
                yield pa.RecordBatch.from_arrays([column[c] for c in columns], columns)

    return packed.select("rows").mapInArrow(run, schema)


def _moved(rows: DataFrame, terms: DataFrame, blocks: int, most: int, of_id: tuple = (), of_token: tuple = ()) -> DataFrame:
    """The rows (token, id, block, positions, ...), dealt out by parts of about `most` in the order of token and block, a partition each. Packed they take from a third
    to two thirds of what they take one by one, the more the fewer postings a document has in a part."""
    cuts = _cuts(terms, most)
    return _unpacked(_packed(rows, cuts, blocks, of_id, of_token).repartitionById(len(cuts) + 1, F.col("part").cast("int")), rows.schema)


def _weight(df, docs: int):
    return F.log(F.lit(float(max(docs, 1))) / (df + 1)) + 1


NO_WORDS = "cast(array() as array<struct<token:string,n:bigint>>)"


def of(corpus: "DataFrame | Index") -> Index:
    """The index of a corpus, derived whenever it is read."""
    if isinstance(corpus, Index):
        return corpus
    posts = postings(corpus)
    weights = idf(posts, corpus_size(corpus))
    entries = _entries(corpus, F.current_timestamp()).join(norms(posts, weights), "id", "left").join(_words(posts), "id", "left")
    entries = entries.withColumns({"segment": F.lit(0), "words": F.coalesce("words", F.expr(NO_WORDS))})
    return Index(entries, posts.withColumn("segment", F.lit(0)), weights)


class Store:
    """An index in a folder, as segments that are never changed. A manifest lists those that count, in order, and is swapped in one step
    (sources.versions), so a change that failed is not seen, and of two writers the later one takes its number after the other's.

    add() writes the postings and entries of the new documents as one segment, sorted by token and by id. With it, and for remove(), go the ids of
    documents that are replaced or removed, and the changes of the document frequencies; so a change reads the ids of the entries, and
    beyond them only rows of its own documents. What they take away is what came before them in the order. merge() makes one segment of all that lives, in which
    norms are kept and postings are ranked: it has blocks of documents of like length, the greatest impact of each token in each block,
    and small row groups in the order of token and block, which a search can skip. It is called beyond a number of segments, and where changes make up a share
    of the documents by the second read of a version, so that changes that follow each other, or one read after them, do not pay for a rebuild each; until then
    searches make the norms they need of the words of their candidates. What the first add() writes is ranked already. Scores are always
    those of an index built anew. vacuum() deletes segments that no manifest names.

    Of rows of one id in an add(), the one of the greatest hash of type and text counts; a null id takes no part. Adding an id again replaces it.
    total_indexed counts every document ever added, total_removed those removed; replacing removes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, folder)
        self._held: tuple[int, Index] | None = None

    def _read(self, name: str, part: str) -> DataFrame:
        out = self.spark.read.parquet(f"{self.folder}/data/{name}/{part}")
        return out.withColumn("tf", F.col("n") / F.col("n_tokens")) if part == "postings" and "tf" not in out.columns else out

    def _path(self, name: str, part: str) -> str:
        return f"{self.folder}/data/{name}/{part}"

    def state(self) -> dict:
        """segments, docs (documents with a token), documents, total_indexed, total_removed of the newest version."""
        return self.versions.newest()[1] or {"segments": [], "docs": 0, "documents": 0, "total_indexed": 0, "total_removed": 0, "next": 1}

    def stats(self) -> DataFrame:
        """One row: documents, vocabulary, total_indexed, total_removed."""
        s = self.state()
        vocabulary = self._vocabulary(s).count() if s["segments"] else 0
        return self.spark.createDataFrame([(s["documents"], vocabulary, s["total_indexed"], s["total_removed"])], "documents long, vocabulary long, total_indexed long, total_removed long")

    # --- changes

    def _union(self, state: dict, part: str, *columns: str) -> DataFrame | None:
        out = None
        for s in state["segments"]:
            if s.get(part):
                own = self._read(s[part], part)
                own = own.select(*(columns or [c for c in own.columns if c not in ("norm", "block", "impact", "type_") and (part != "terms" or c != "idf")])).withColumn("segment", F.lit(s["place"]))
                out = own if out is None else out.unionByName(own)
        return out

    def _live(self, state: dict, *columns: str) -> DataFrame | None:
        entries = self._union(state, "entries", *columns)
        gone = self._union(state, "gone")
        if entries is None or gone is None:
            return entries
        since = small_or_not(gone.groupBy("id").agg(F.max("segment").alias("since")), IDS)
        return entries.join(since, "id", "left").filter("since is null or since <= segment").drop("since")

    def _effect(self, state: dict, ids: DataFrame, added: DataFrame | None, name: str) -> dict:
        """Writes which living documents go, and by how much each df changes. added: (token, n) of the new ones."""
        live, out = self._live(state, "id"), {"gone": None, "went": 0, "went_docs": 0}
        changes = [] if added is None else [added]
        if live is not None:
            live.join(ids.select("id").distinct(), "id", "left_semi").select("id").write.parquet(self._path(name, "gone"))
            gone = self._read(name, "gone")
            span = gone.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
            if span["n"]:
                # the span of the ids reaches the scan, whose files are in the order of id
                dead = self._live(state, "id", "words").filter(F.col("id").between(F.lit(span["low"]), F.lit(span["high"]))).join(small_or_not(gone, IDS), "id", "left_semi")
                dead = stored(dead.select("id", "words"), "dead")
                changes.append(dead.select(F.explode("words.token").alias("token"), F.lit(-1).cast("long").alias("n")))
                out = {"gone": name, "went": span["n"], "went_docs": dead.filter("size(words) > 0").count()}
        if changes:
            every = changes[0] if len(changes) == 1 else changes[0].union(changes[1])
            every.groupBy("token").agg(F.sum("n").alias("df")).filter("df <> 0").repartitionByRange("token").sortWithinPartitions("token").write.parquet(self._path(name, "terms"))
            out["terms"] = name
        if live is not None and out["gone"]:
            drop_stored(dead)
        return out

    def _commit(self, make, attempts: int = 10) -> None:
        """make(state) writes what depends on the state and returns the next one; it is called again if another writer came first."""
        for _ in range(attempts):
            number, state = self.versions.newest()
            if self.versions.commit(number + 1, make(state or self.state())):
                return
        raise RuntimeError(f"other writers changed {self.folder} {attempts} times in a row")

    def add(self, corpus: DataFrame, at: str | None = None) -> "Store":
        now = F.current_timestamp() if at is None else F.to_timestamp(F.lit(at))
        own = _one_each(stored(_counted(corpus.filter("id is not null")), "counted"))
        plain = F.transform("words", lambda w: F.struct(w["token"].alias("token"), w["n"].alias("n")))
        entries = own.select("id", "type", "metadata", "token_count", F.size("words").alias("unique_tokens"), now.alias("indexed_at"), plain.alias("words"))
        share = F.col("w.n") / F.col("token_count")
        posts = lambda docs, *more: docs.select("id", "token_count", *more, F.explode("words").alias("w")).select("id", "w.token", "w.n", share.alias("tf"), F.col("token_count").alias("n_tokens"), "w.positions", *more)
        name = self.versions.fresh()
        if not self.state()["segments"]:
            made = self._base(entries, lambda known: posts(known(own.drop("type", "metadata", "content")), "type_", "block", "norm"), name)
        else:
            self._write_entries(entries, name)
            posts(own).drop("tf").repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE).parquet(self._path(name, "postings"))
            counted = self._read(name, "entries").agg(F.count("*").alias("n"), F.count_if(F.col("token_count") > 0).alias("docs")).first()
            made = {"documents": counted["n"], "docs": counted["docs"], "ranked": False}
        words = self._read(name, "postings").select("token", F.lit(1).cast("long").alias("n"))

        def make(state: dict) -> dict:
            first = not state["segments"]
            if made["ranked"] and first:
                effect = {"terms": name, "gone": None, "went": 0, "went_docs": 0}
            else:
                effect = self._effect(state, own, words, self.versions.fresh())
            segment = {"place": state["next"], "entries": name, "postings": name, "terms": effect.get("terms"), "gone": effect["gone"], "ranked": made["ranked"] and first, "documents": made["documents"]}
            return {
                "segments": [*state["segments"], segment], "docs": state["docs"] + made["docs"] - effect["went_docs"], "documents": state["documents"] + made["documents"] - effect["went"],
                "total_indexed": state["total_indexed"] + made["documents"], "total_removed": state["total_removed"], "next": state["next"] + 1,
            }

        self._commit(make)
        drop_stored(own)
        return self._merge_if_many()

    def remove(self, ids: DataFrame) -> "Store":
        def make(state: dict) -> dict:
            effect = self._effect(state, ids, None, self.versions.fresh())
            segment = {"place": state["next"], "entries": None, "postings": None, "terms": effect.get("terms"), "gone": effect["gone"], "ranked": False, "documents": effect["went"]}
            return state | {
                "segments": [*state["segments"], segment] if effect["went"] else state["segments"], "docs": state["docs"] - effect["went_docs"], "documents": state["documents"] - effect["went"],
                "total_removed": state["total_removed"] + effect["went"], "next": state["next"] + 1,
            }

        if self.state()["segments"]:
            self._commit(make)
        return self._merge_if_many()

    def _merge_if_many(self) -> "Store":
        return self.merge() if len(self.state()["segments"]) > SEGMENTS else self

    @staticmethod
    def _due(state: dict) -> bool:
        """Whether changes make up such a share of the documents that searches are better served by a merged index."""
        return sum(s["documents"] for s in state["segments"][1:]) > SHARE * state["segments"][0]["documents"]

    def _write_entries(self, entries: DataFrame, name: str, source: DataFrame | None = None, scattered: bool = False) -> None:
        """In the order of id, which scattered entries have lost. Entries whose files (those of source, a stored table) come in that order are not moved, nor are those whose files hold long runs of it,
        as where a task read some files of an ordered table: their row groups, sorted, are nearly as narrow."""
        known = (entries if source is None else source).select("id", F.input_file_name().alias("f"))
        spans = [] if scattered else known.groupBy("f").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
        if scattered or any(a["high"] >= b["low"] for a, b in zip(spans, spans[1:])) and not self._in_runs(known, spans):
            entries = entries.repartitionByRange("id")
        entries.sortWithinPartitions("id").write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(self._path(name, "entries"))

    @staticmethod
    def _in_runs(known: DataFrame, spans: list) -> bool:
        """Whether a stretch of ids, of about a thousand or of a thousandth of all, lies in two files at most on average."""
        steps = min(1000, sum(s["n"] for s in spans) // 1000)
        low, high = min(s["low"] for s in spans), max(s["high"] for s in spans)
        if not steps or not isinstance(low, int):
            return False
        stretch = F.floor((F.col("id") - F.lit(low)).cast("double") / (high - low + 1) * steps)
        each = known.groupBy("f", stretch.alias("s")).agg(F.lit(1).alias("n")).groupBy("s").count()
        return each.agg(F.avg("count")).first()[0] <= 2

    def _base(self, entries: DataFrame, posts_of, name: str) -> dict:
        """Writes living documents as one ranked segment: norms, terms with idf, postings in blocks with impacts, bounds. entries are stored; posts_of(known) are
        their postings with what known(rows) adds to rows with an id: type_, block, norm. Postings are moved once, into their order; all else is known of the words of a document."""
        counted = entries.agg(F.count("*").alias("n"), F.count_if(F.col("token_count") > 0).alias("docs"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("posts")).first()
        terms = entries.select(F.explode("words.token").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        terms.withColumn("idf", _weight(F.col("df"), counted["docs"])).repartitionByRange("token").sortWithinPartitions("token").write.option("parquet.block.size", ROW_GROUP).parquet(self._path(name, "terms"))
        with_df = _frequencies(self._read(name, "terms").select("token", "df"))
        each = entries.select("id", "token_count", F.explode("words").alias("w")).select("id", F.col("w.token").alias("token"), (F.col("w.n") / F.col("token_count")).alias("tf"))
        w = F.col("tf") * _weight(F.col("df"), counted["docs"])
        n = F.sqrt(F.sum(w * w))
        norm = stored(with_df(each).groupBy("id").agg(F.when(n == 0, 1.0).otherwise(n).alias("norm")), "norms")
        # like lengths share a block: short documents have the great impacts; the hash tells equal lengths apart
        place = F.col("token_count") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
        blocks = max(1, min(BLOCKS, counted["n"] // 64))
        cuts = entries.agg(F.percentile_approx(place, [i / blocks for i in range(1, blocks)] or [1.0], 10_000).alias("c")).first()["c"] or [] if blocks > 1 else []
        block = F.size(F.filter(F.split(F.lit(",".join(map(repr, map(float, cuts)))), ",").cast("array<double>"), lambda c: c < place)) if cuts else F.lit(0)
        docs = stored(entries.select("id", F.col("type").alias("type_"), block.alias("block")).join(small_or_not(norm, IDS), "id", "left"), "docs")
        known = _met(docs)
        self._write_entries(known(entries).drop("type_"), name, entries, _too_many(docs))
        # what follows from other columns is left out until the rows are in their order; counts and norms, unlike impacts, are alike from row to row
        ranked = with_df(posts_of(known)).select("id", "token", "n_tokens", "positions", "type_", "block", F.col("df").cast("int").alias("df"), "norm")
        # larger parts, up to four times, keep more postings of a document together
        most = min(4 * POSTINGS, max(POSTINGS, counted["posts"] // PARTS))
        ranked = _moved(ranked, self._read(name, "terms"), blocks, most, ("n_tokens", "type_", "block", "norm"), ("df",)).sortWithinPartitions("token", "block", "id")
        n = F.size("positions").cast("long")
        ranked = ranked.select("token", "id", n.alias("n"), "n_tokens", "positions", "type_", "block", (n / F.col("n_tokens") * _weight(F.col("df"), counted["docs"]) / F.col("norm")).alias("impact"))
        ranked.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE).parquet(self._path(name, "postings"))
        _greatest(self._read(name, "postings")).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(self._path(name, "bounds"))
        drop_stored(norm, docs)
        return {"documents": counted["n"], "docs": counted["docs"], "ranked": True}

    def merge(self) -> "Store":
        """One ranked segment of all that lives; what other writers add meanwhile stays on top of it."""
        for _ in range(10):
            state = self.state()
            if not state["segments"] or (len(state["segments"]) == 1 and state["segments"][0]["ranked"]):
                return self
            live = stored(self._live(state), "live")
            every = self._union(state, "postings", "id", "token", "n", "tf", "n_tokens", "positions")
            name = self.versions.fresh()
            # an id lives in one segment only
            places = _met(live.select("id", "segment"))
            made = self._base(live.drop("segment"), lambda known: known(places(every, ["id", "segment"]).drop("segment")), name)
            drop_stored(live)
            base = {"place": state["segments"][-1]["place"], "entries": name, "postings": name, "terms": name, "gone": None, "ranked": True, "documents": made["documents"]}
            while True:
                number, now = self.versions.newest()
                if now["segments"][: len(state["segments"])] != state["segments"]:
                    break  # another writer merged these
                if self.versions.commit(number + 1, now | {"segments": [base, *now["segments"][len(state["segments"]) :]]}):
                    return self
        raise RuntimeError(f"other writers merged {self.folder} time and again")

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> int:
        parts = ("entries", "postings", "terms", "gone")
        return self.versions.vacuum(lambda m: {s[p] for s in m["segments"] for p in parts if s.get(p)}, keep, older_than)

    # --- reading

    def _vocabulary(self, state: dict) -> DataFrame:
        """token, df of all segments."""
        return self._union(state, "terms", "token", "df").groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")

    def tables(self) -> Index:
        """What searches read. A version that is read again is merged first if that is due."""
        number, state = self.versions.newest()
        if not number or not state["segments"]:
            raise ValueError(f"nothing was added to {self.folder}")
        if self._held is not None and self._held[0] == number and self._due(state):
            self.merge()
            number, state = self.versions.newest()
        if self._held is None or self._held[0] != number:
            only = state["segments"][0]
            if len(state["segments"]) == 1 and only["ranked"]:
                at = F.lit(only["place"]).alias("segment")
                own = Index(*[self._read(only[p], p).select("*", at) if p != "terms" else self._read(only[p], p) for p in ("entries", "postings", "terms")], self._read(only["postings"], "bounds"))
            else:
                own = Index(self._live(state), self._union(state, "postings", "id", "token", "n", "tf", "n_tokens", "positions"), self._vocabulary(state).withColumn("idf", _weight(F.col("df"), state["docs"])))
            self._held = (number, own)
        return self._held[1]


def add(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """A corpus with more documents; adding an id again replaces it."""
    return corpus.join(new, "id", "left_anti").select(*new.columns).unionByName(new)


def remove(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    return corpus.join(ids, "id", "left_anti")
