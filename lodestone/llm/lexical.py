"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

A term is a longest run of ASCII letters and digits and of any other characters beyond ASCII, A-Z lower-cased. Documents are put into shards as they are
read, without a shuffle: a task closes a shard at some million postings. A shard is one row in compressed sparse form: its terms in order, the
documents that hold each, and for each posting its impact (10^9 tf) div (1000 tf + 8 m), m being 25 + (75 n N) div L. N, the number of documents with a
term, and L, their terms together, are one row, known when the shards are first written; a second pass without a shuffle turns counts into impacts.
What of the score belongs to a term alone, w = floor(1000 ln((2 N + 2) / (2 df + 1))), is found at the query for the terms asked, from the shards'
own counts, so no vocabulary of the corpus is built.

Items are asked in blocks of bounded size, which meet every shard. There each term adds its impacts to a dense accumulator, term by term; the k best
are cut by argpartition, with all ties of the k-th, of which the smaller doc_ids stay (a shard is in the order of doc_id). The k best of
each shard are merged by item, in partial cuts first.

A null text has no term, and a document without terms counts nowhere. Rows that repeat a doc_id are documents of their own; a null doc_id comes after all
others of its score. Rows of one item_id are one item with the terms of all its different texts; a null item_id is an item too. Items without
a term of the corpus, and empty tables, give no rows. Other columns are ignored. All integers are of 64 bits.
"""

import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_stored, small_or_not, stored

POSTINGS = 1 << 20  # of a shard, or one document's
ITEMS, TERMS, BLOCKS = 256, 16_384, 64  # of a block of queries, and blocks of a pass
GROUP = 16 << 20  # bytes of a row group of shards
ASKED = 1_000_000  # terms of all items up to which they are broadcast

_KEPT = (string.ascii_letters + string.digits).encode()
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or c in _KEPT else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Bytes beyond ASCII belong to characters of terms, so the cuts are the same as on characters."""
    return (text or "").encode().translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, term):
        self[term] = n = len(self)
        return n


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self):
        self.number, self.ids, self.lengths, self.terms, self.tf, self.postings = _Numbers(), [], [], [], [], 0

    def add(self, doc_id, words: list[bytes]) -> None:
        own = Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)))
        self.tf.append(np.fromiter(own.values(), np.int64, len(own)))
        self.postings += len(own)

    def row(self, shard: int, id_type: pa.DataType) -> pa.RecordBatch:
        ids = pa.array(self.ids, id_type)
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        names = sorted(self.number)
        rank = np.empty(len(names), np.int64)
        rank[[self.number[t] for t in names]] = np.arange(len(names))
        term, doc = rank[np.concatenate(self.terms)], np.repeat(place, [len(t) for t in self.terms])
        order = np.argsort(term * len(ids) + doc)
        df = np.bincount(term, minlength=len(names)).astype(np.int32)
        lengths = np.array(self.lengths, np.int64)[by_id]
        one = lambda a: pa.ListArray.from_arrays([0, len(a)], a)
        values = [
            pa.array([shard], pa.int64()), pa.array([b"\n".join(names).decode()]), one(pa.array(df)), pa.array([doc[order].astype("<u4").tobytes()], pa.binary()),
            pa.array([np.concatenate(self.tf)[order].astype("<u4").tobytes()], pa.binary()), one(ids.take(pa.array(by_id))), pa.array([lengths.tobytes()], pa.binary()),
            pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(values, ["shard", "terms", "df", "docs", "tf", "ids", "lengths", "n_docs", "n_terms"])


def _shards(id_type: pa.DataType, most: int):
    def run(batches):
        first, made, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    words = terms(text)
                    if words:
                        shard.add(doc_id, words)
                    if shard.postings >= most:
                        yield shard.row(first + made, id_type)
                        made, shard = made + 1, _Shard()
        if shard.postings:
            yield shard.row(first + made, id_type)

    return run


def _impacts(n_docs: int, n_terms: int):
    """Of (shard, terms, df, docs, tf, ids, lengths): the row with impacts in place of tf and lengths."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                doc, tf, n = (np.frombuffer(b.column(c)[i].as_buffer(), t).astype(np.int64) for c, t in ((3, "<u4"), (4, "<u4"), (6, "<i8")))
                m = 25 + (75 * n * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])  # a million at most
                own = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(3), pa.array([impact.astype("<i4").tobytes()], pa.binary()), own.column(5)], ["shard", "terms", "df", "docs", "impact", "ids"])

    return run


def _kept(shards: DataFrame, tag: str) -> DataFrame:
    """A stored table of shards. A shard is a row of megabytes, and the writer would hold a hundred before it looks at their size, the reader a whole group."""
    return stored(shards, tag, options={"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})


class Index:
    """shards: shard, terms (joined by line ends), df, docs, impact, ids; the documents with a term, and their terms."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms

    def drop(self) -> None:
        drop_stored(self.shards)


def build(docs: DataFrame, postings: int = POSTINGS) -> Index:
    """The stored index of all documents (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
    kind = kind if id_type != pa.string() else "string"
    schema = f"shard long, terms string, df array<int>, docs binary, tf binary, ids array<{kind}>, lengths binary, n_docs long, n_terms long"
    raw = _kept(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInArrow(_shards(id_type, postings), schema), "lexical-counts")
    total = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    made = raw.select("shard", "terms", "df", "docs", "tf", "ids", "lengths").mapInArrow(_impacts(total["n"], total["l"]), f"shard long, terms string, df array<int>, docs binary, impact binary, ids array<{kind}>")
    out = Index(_kept(made, "lexical"), total["n"], total["l"])
    drop_stored(raw)
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores above 0, greatest first, of equal ones the first place."""
    least = 1
    if len(scores) > k:
        top = np.argpartition(scores, len(scores) - k)[len(scores) - k :]
        least = max(1, scores[top].min())
    at = np.flatnonzero(scores >= least)  # with every tie of the last
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _search(k: int, item_type: pa.DataType, id_type: pa.DataType):
    """Of (shard, terms, df, docs, impact, ids, items): item_id, doc_id, score of each shard's best."""

    def run(batches):
        held = None
        for b in batches:
            for i in range(len(b)):
                if held != b.column(0)[i].as_py():
                    held = b.column(0)[i].as_py()
                    number = {t: j for j, t in enumerate(b.column(1)[i].as_py().split("\n"))}
                    start = np.concatenate([[0], np.cumsum(b.column(2)[i].values.to_numpy().astype(np.int64))])
                    doc, impact = np.frombuffer(b.column(3)[i].as_buffer(), "<u4"), np.frombuffer(b.column(4)[i].as_buffer(), "<i4")
                    ids = b.column(5)[i].values
                items, at, found = [], [], []
                scores = np.zeros(len(ids), np.int64)
                for item in b.column(6)[i].as_py():
                    scores.fill(0)
                    for part in item["parts"]:
                        j = number.get(part["term"])
                        if j is not None:
                            s, e = start[j], start[j + 1]
                            scores[doc[s:e]] += part["weight"] * impact[s:e].astype(np.int64)
                    best = _best(scores, k)
                    items += [item["item_id"]] * len(best)
                    at.append(best)
                    found.append(scores[best])
                at, found = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *found])
                yield pa.RecordBatch.from_arrays([pa.array(items, item_type), ids.take(pa.array(at)).cast(id_type), pa.array(found)], ["item_id", "doc_id", "score"])

    return run


def _asked(items: DataFrame) -> DataFrame:
    """item_id, term, n: the terms of each item with their numbers."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    words = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", "text").distinct().select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the greatest scores above 0 for each item (item_id, text). The table is stored."""
    asked = stored(_asked(items), "lexical-asked")
    words = stored(asked.select("term").distinct(), "lexical-words")
    own = index.shards.select(F.explode(F.arrays_zip(F.split("terms", "\n").alias("term"), F.col("df").alias("df"))).alias("t")).select("t.term", "t.df")
    df = own.join(small_or_not(words, ASKED), "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = stored(asked.join(df, "term").select("item_id", "term", (F.col("n") * w).alias("weight")).filter("weight > 0"), "lexical-weights")
    size = weighted.agg(F.count_distinct("item_id").alias("items"), F.count("*").alias("terms")).first()
    blocks = max(1, -(-size["items"] // ITEMS), -(-size["terms"] // TERMS))
    each = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("parts"))
    packs = each.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "parts")).alias("items"))
    packs = stored(packs, "lexical-blocks")
    like = packs.select(F.col("items")[0]["item_id"].alias("item_id")), index.shards.select(F.col("ids")[0].alias("doc_id"))
    types, kinds = [to_arrow_schema(t.schema).field(0).type for t in like], [t.dtypes[0][1] for t in like]
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    out = None
    for low in range(0, blocks, BLOCKS):
        high = min(low + BLOCKS, blocks) - 1
        some = F.broadcast(packs.filter(F.col("block").between(low, high)))  # BLOCKS blocks, each bounded in items and terms
        met = index.shards.withColumn("block", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")))).join(some, "block")
        found = met.select("shard", "terms", "df", "docs", "impact", "ids", "items").mapInArrow(_search(k, *types), f"item_id {kinds[0]}, doc_id {kinds[1]}, score long")
        best = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "lexical-found")
        out = best if out is None else out.union(best)
    drop_stored(asked, words, weighted, packs)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index and search in one; the index is dropped afterwards."""
    index = build(docs)
    out = search(index, items, k)
    index.drop()
    return out
