"""BPE encoding and decoding through a table of distinct words.

Words are the pieces between the cuts that the byte-level pre-tokenizer always makes (a space before a visible
character). Texts are split in blocks of some 16 MB; a block keeps its distinct words, the frequent first, and its documents as
positions in that list, compressed: less than half of the text's compressed size. The words of up to `TOGETHER` blocks (4 GB of text) meet by
a hash range of the word, in compressed bags; each distinct word of a range is encoded once there, and its ids go back to the block by
position. There the documents are put together, and decoded by joining every id to its piece (the tokenizer's vocabulary: bounded). No
step broadcasts or collects the words, and a frequent word occurs once for each block at most, not once for each use. A task holds
the words of one of `RANGES` ranges of `TOGETHER` blocks, or one block, however large the input: beyond 4 GB a word is encoded
once for every 4 GB.

encode() gives ids and decoded text; digests() only their hashes. A null or empty text has no ids and decodes to ''.
A special token spelled out in a text becomes its id, as in the tokenizers library. Repeated rows are each reported, doc_id may be
null and of any type (integers come back as 64-bit ones, others as text), an empty table gives no rows. Other columns are ignored. What is
stored on the way is deleted.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch, stored
from .tokens import cut, read_blob, tokenizer

BLOCK, TOGETHER, RANGES = 16 << 20, 256, 64
RUN = 1 << 16  # words of a document whose ids are gathered at once
INTS = ("bigint", "int", "smallint", "tinyint")


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers byte by byte: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def pack_words(words: list[bytes]) -> bytes:
    return _squeeze(np.array([len(words), *map(len, words)], dtype="<u4"), np.frombuffer(b"".join(words), dtype=np.uint8))


def unpack_words(data: bytes) -> list[str]:
    data = _expand(data)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, dtype="<u4", count=n, offset=4)) + 4 * n + 4).tolist()
    return [data[a:b].decode() for a, b in zip([4 * n + 4, *ends], ends)]


def pack_ids(ids: list[bytes], kind: str) -> bytes:
    """The ids of some words, each given as the bytes of an array of this kind."""
    size = np.dtype(kind).itemsize
    return _squeeze(np.array([len(ids), *[len(x) // size for x in ids]], dtype="<u4"), np.frombuffer(b"".join(ids), dtype=np.uint8))


def unpack_ids(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all of them."""
    data = _expand(data)
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, dtype="<u4", count=n, offset=4), np.frombuffer(data, dtype=kind, offset=4 * n + 4)


def _rows(batches):
    """(doc_id, text) of every row; few texts at once are Python strings."""
    for b in batches:
        for at in range(0, len(b), 128):
            part = b.slice(at, 128)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _blocks(arrow_id):
    def run(batches):
        from pyspark import TaskContext

        head, seq = TaskContext.get().partitionId() << 24, 0
        where: dict[str, int] = {}
        keys, sizes, codes, held = [], [], [], 0

        def flush():
            plain = [w.encode() for w in where]
            where.clear()
            code = np.concatenate(codes)
            codes.clear()
            count = np.bincount(code, minlength=len(plain))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = [plain[i] for i in order.tolist()]
            of = np.fromiter((xxhash.xxh32_intdigest(w) % RANGES for w in words), dtype=np.uint32, count=len(words))
            by = np.argsort(of, kind="stable")
            used, first = np.unique(of[by], return_index=True)
            bags = [{"range": int(r), "words": pack_words([words[i] for i in x.tolist()])} for r, x in zip(used, np.split(by, first[1:]))]
            return pa.RecordBatch.from_arrays(
                [pa.array([head + seq], pa.int64()), pa.array([keys], pa.list_(arrow_id)), pa.array([sizes], pa.list_(pa.int32())), pa.array([_squeeze(_planes(rank[code]))], pa.binary()), pa.array([_squeeze(_planes(of))], pa.binary()), pa.array([bags], pa.list_(pa.struct([("range", pa.int32()), ("words", pa.binary())])))],
                ["block", "keys", "sizes", "codes", "ranges", "bags"],
            )

        for key, text in _rows(batches):
            pieces = cut(text or "")
            for p in pieces:
                if p not in where:
                    where[p] = len(where)
            codes.append(np.fromiter(map(where.__getitem__, pieces), dtype=np.uint32, count=len(pieces)))
            keys.append(key)
            sizes.append(len(pieces))
            held += len(text or "") + 64
            if held >= BLOCK:
                yield flush()
                where, keys, sizes, codes, held = {}, [], [], [], 0
                seq += 1
        if keys:
            yield flush()

    return run


def _encode_range(blob, kind):
    """The bags of one hash range in, the ids of their words in the same order out; each word is encoded once."""

    def run(bags):
        tok = tokenizer(blob.value)
        lists = [unpack_words(x) for x in bags["words"].to_pylist()]
        words = list({w for x in lists for w in x})
        ids = {}
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids.update((w, np.array(e.ids, dtype=kind).tobytes()) for w, e in zip(some, tok.encode_batch_fast(some, add_special_tokens=False)))
        return pa.table({"block": bags["block"], "range": bags["range"], "ids": pa.array([pack_ids([ids[w] for w in x], kind) for x in lists], pa.binary())})

    return run


def _byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: visible Latin-1 characters stand for themselves, the other bytes for 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_to_piece(blob: str) -> dict[int, bytes]:
    """The bytes of every id."""
    tok, byte_of = tokenizer(blob), _byte_of()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    return {i: t.encode() if t in special else bytes(map(byte_of.__getitem__, t)) for t, i in tok.get_vocab(with_added_tokens=True).items()}


def _decoded(ids: list[int], piece: dict[int, bytes]) -> str:
    return b"".join(map(piece.__getitem__, ids)).decode("utf-8", "replace")


def _assemble(finish, pieces, kind):
    def run(left, right):
        return finish(left, _documents(left, right, kind), pieces.value)

    return run


def _documents(left, right, kind):
    """(doc_id, its ids) for the documents of one block; the ids of its words lie end to end in one array, in order of range."""
    if not left.num_rows:
        return
    of = _from_planes(_expand(left["ranges"][0].as_py()))
    got = [unpack_ids(right["ids"][i].as_py(), kind) for i in np.argsort(right["range"].to_numpy()).tolist()]
    flat = np.concatenate([np.zeros(0, kind), *[x for _, x in got]])
    by = np.argsort(of, kind="stable")
    counts, starts = np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
    counts[by] = np.concatenate([np.zeros(0, np.int64), *[n for n, _ in got]])
    starts[by] = np.cumsum(counts[by]) - counts[by]
    del got, by, of

    codes = _from_planes(_expand(left["codes"][0].as_py()))
    at = 0
    for key, size in zip(left["keys"][0].as_py(), left["sizes"][0].as_py()):
        parts = [np.zeros(0, kind)]
        for x in range(at, at + size, RUN):
            code = codes[x : min(x + RUN, at + size)]
            n = counts[code]
            parts.append(flat[np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        yield key, np.concatenate(parts)
        at += size


def _joined(docs: DataFrame, tokenizer_path: str | None, finish, out: str) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    text = read_blob(tokenizer_path)
    blob, pieces = sc.broadcast(text), sc.broadcast(id_to_piece(text))
    width = "<u2" if tokenizer(text).get_vocab_size() <= 1 << 16 else "<u4"
    kind = dict(docs.dtypes)["doc_id"]
    arrow_id, kind, key = (pa.int64(), "bigint", F.col("doc_id").cast("long")) if kind in INTS else (pa.string(), "string", F.col("doc_id").cast("string"))
    path, buckets = scratch(spark, "bpe-blocks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"block long, keys array<{kind}>, sizes array<int>, codes binary, ranges binary, bags array<struct<range:int,words:binary>>"
    # bucketed by block, so that the codes meet their ids without being shuffled
    name = "lodestone_" + path.rsplit("/", 1)[1].replace("-", "_")
    made = docs.select(key.alias("doc_id"), "text").mapInArrow(_blocks(arrow_id), schema)
    made.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    try:
        blocks = spark.table(name)
        groups = max(1, -(-blocks.count() // TOGETHER))
        group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("together")
        bags = blocks.select("block", group, F.explode("bags").alias("bag")).select("block", "together", "bag.range", "bag.words")
        coded = bags.groupBy("together", "range").applyInArrow(_encode_range(blob, width), "block long, range int, ids binary")
        packed = blocks.select("block", "keys", "sizes", "codes", "ranges")
        done = packed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(finish, pieces, width), out.replace("ID", kind))
        return stored(done, "bpe-done")
    finally:
        spark.sql(f"drop table {name}")
        drop_path(spark, path)


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def finish(left, documents, piece):
        names = {i: str(i) for i in piece}
        out = ([], [], [], [])
        for key, ids in documents:
            out[0].append(key)
            out[1].append(len(ids))
            ids = ids.tolist()
            out[2].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            out[3].append(hashlib.sha256(_decoded(ids, piece).encode()).hexdigest())
        return pa.table({"doc_id": pa.array(out[0], left.schema.field("keys").type.value_type), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})

    return _joined(docs, tokenizer_path, finish, "doc_id ID, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded."""

    def finish(left, documents, piece):
        rows = [(key, ids.astype(np.int32), _decoded(ids.tolist(), piece)) for key, ids in documents]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], left.schema.field("keys").type.value_type), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "decoded": pa.array([r[2] for r in rows], pa.string())})

    return _joined(docs, tokenizer_path, finish, "doc_id ID, ids array<int>, decoded string")
