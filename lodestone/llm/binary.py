"""Token ids as length-delimited binary records, with masked checksums and a separate offset index.

Documents are dealt out by ranges of doc_id, sorted, encoded, and written as one data file and one index file for each
range; there are as many ranges as shuffle partitions, or more, so that one holds about `file_bytes` of input. A record is: length (8 bytes), masked crc32 of those bytes (4), payload, masked crc32 of the payload (4), all
little-endian; the payload is the ids as unsigned 16-bit integers when the vocabulary allows it, else 32-bit. The mask rotates a
checksum by 15 bits and adds a constant, so that a checksum of bytes that hold checksums stays useful. The index holds doc_id,
offset and count of ids for each record, which is all that a shuffled read needs.

Each task writes under a name of its own and the names that count are those the tasks report, so a task that runs twice or
dies leaves a file that no one reads. Files are read back by the reported names, every checksum is verified, and the start of a
document is the sum of what the files before it and the records before it hold.

A null text is empty: one record with the end id alone. A null doc_id sorts first; integer ids of any width are written as 64-bit ones, all
others as text, in the order of their own type. Rows that share a doc_id are each written, next to each other, shorter texts first, and
may span files; rows that are equal in id and text go to one file. An empty table writes no files. Other columns are ignored.
"""

import io
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .tokens import UNSAFE, cut, read_blob, tokenizer, worker_store

MASK = 0xA282EAD8  # fixed value of the record format
AT_ONCE = 16 << 20  # bytes of text whose words are told apart at once
KNOWN = 1 << 20  # words and bytes of 16 each of which a worker keeps the ids


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(buffer: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at a place, and the place after it; ValueError if a checksum is wrong."""
    head = buffer[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", buffer, at + 8)[0] != masked(head):
        raise ValueError(f"length of the record at {at} is damaged")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = buffer[at + 12 : end]
    if len(buffer) < end + 4 or struct.unpack_from("<I", buffer, end)[0] != masked(payload):
        raise ValueError(f"record at {at} is damaged")
    return payload, end + 4


def _table(pieces: list[str], tok, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the place and count of those of each piece. Pieces are encoded as lines of one text, since the pre-tokenizer always cuts at a line feed between visible
    characters; those that hold line feeds or begin or end with other white space, and lines whose feeds do not come out as they went in, are encoded alone."""
    if not pieces:
        return np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
    feed = tok.encode("\n", add_special_tokens=False).ids
    starts, sizes, out, base = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
    alone = [i for i, p in enumerate(pieces) if not p or len(feed) > 1 or "\n" in p or p[-1].isspace() or (p[0] != " " and p[0].isspace())]
    plain = np.ones(len(pieces), bool)
    plain[alone] = False
    lines = np.flatnonzero(plain)
    groups = [lines[i : i + 256] for i in range(0, len(lines), 256)]
    for at in range(0, len(groups), 32):
        some = groups[at : at + 32]
        for own, e in zip(some, tok.encode_batch_fast(["\n".join([*map(pieces.__getitem__, own.tolist()), ""]) for own in some], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            ends = np.flatnonzero(ids == feed[0])
            if len(ends) != len(own):
                alone += own.tolist()
                continue
            first = np.concatenate([[0], ends[:-1] + 1])
            starts[own], sizes[own] = base + first, ends - first
            out.append(ids)
            base += len(ids)
    for at in range(0, len(alone), 4096):
        some = alone[at : at + 4096]
        for i, e in zip(some, tok.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
            starts[i], sizes[i] = base, len(e.ids)
            out.append(np.array(e.ids, kind))
            base += len(e.ids)
    return np.concatenate(out) if out else np.zeros(0, kind), starts, sizes


def _words(words: pa.LargeStringArray, blob: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_table() of different words after a space. A worker keeps the ids of the first KNOWN words it meets, in arrays, for its later batches and tasks."""
    held = worker_store("words")
    if (blob, kind) not in held:
        held.clear()
        held[blob, kind] = words.slice(0, 0), *_table([], None, kind)
    known, flat, starts, sizes = held[blob, kind]
    at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
    new = np.flatnonzero(at < 0)
    fresh = words.take(pa.array(new))
    more, begins, counts = _table([" " + w for w in fresh.to_pylist()], tokenizer(blob), kind)
    begins = begins + len(flat)
    out = np.concatenate([flat, more])
    place, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    old = at >= 0
    place[old], n[old], place[new], n[new] = starts[at[old]], sizes[at[old]], begins, counts
    if len(known) + len(fresh) <= KNOWN and known.nbytes + fresh.nbytes <= 16 * KNOWN:
        held[blob, kind] = pa.concat_arrays([known, fresh]), out, np.concatenate([starts, begins]), np.concatenate([sizes, counts])
    return out, place, n


def _encode(texts: list[str], blob: str, kind: str) -> list[bytes]:
    """Ids of each text as bytes. Each different word of the texts is encoded once; Arrow tells them apart and numpy puts their ids together. Texts that
    cannot be cut before every space are cut one by one."""
    cuts = {i: cut(t) for i, t in enumerate(texts) if UNSAFE.search(t)}
    plain = ["" if i in cuts else t for i, t in enumerate(texts)]
    words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    offsets, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
    codes, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    codes[offsets[:-1]] = many + np.arange(len(texts))  # no space before the first word of a text
    rest = list({p for ps in cuts.values() for p in ps})
    flat, starts, sizes = _words(coded.dictionary, blob, kind)
    others, begins, counts = _table([t.split(" ", 1)[0] for t in plain] + rest, tokenizer(blob), kind)
    flat, starts, sizes = np.concatenate([flat, others]), np.concatenate([starts, begins + len(flat)]), np.concatenate([sizes, counts])
    n = sizes[codes]
    ends = np.cumsum(n)
    out = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))].tobytes()
    bounds = (np.concatenate([[0], ends])[offsets] * flat.itemsize).tolist()
    own = {p: flat[starts[i] : starts[i] + sizes[i]].tobytes() for i, p in enumerate(rest, many + len(texts))}
    return [b"".join(map(own.__getitem__, cuts[i])) if i in cuts else out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def _pieces(batch: pa.RecordBatch, most: int):
    """Slices of about `most` bytes of text (column 1), or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def _ranges(docs: DataFrame, file_bytes: int) -> int:
    """From Spark's estimate of the input, which costs no scan; where it has none, or multiplies the sides of a join, from the texts."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= 1 << 60 or "Join" in plan.toString():
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))


def write(docs: DataFrame, folder: str, end_id: int = 2, tokenizer_path: str | None = None, file_bytes: int = 128 << 20) -> DataFrame:
    """Writes the files and returns one row for each: path, part (in the order of doc_id), records, ids, kind, id_type. The table is stored."""
    blob = docs.sparkSession.sparkContext.broadcast(read_blob(tokenizer_path))
    kind = "<u2" if tokenizer(blob.value).get_vocab_size() <= 1 << 16 else "<u4"
    id_type = dict(docs.dtypes)["doc_id"]
    arrow_id, id_type = (pa.int64(), "bigint") if id_type in ("bigint", "int", "smallint", "tinyint") else (pa.string(), "string")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, base = _place(folder)
        tail, offset, n_ids, ids, offsets, counts, out = np.array([end_id], dtype=kind).tobytes(), 0, 0, [], array("q"), array("q"), None
        for b in batches:
            for rows in _pieces(b, AT_ONCE):
                if out is None:
                    fs.create_dir(base)
                    out = fs.open_output_stream(_place(name + ".rec")[1])
                buffer = io.BytesIO()
                ids.append(rows.column(0))
                for payload in _encode([t or "" for t in rows.column(1).to_pylist()], blob.value, kind):
                    payload += tail
                    offsets.append(offset)
                    counts.append(len(payload) // int(kind[-1]))
                    n_ids += counts[-1]
                    offset += buffer.write(frame(payload))
                out.write(buffer.getvalue())
        if out is not None:
            out.close()
            index = pa.table({"doc_id": pa.chunked_array(ids, arrow_id), "offset": np.frombuffer(offsets, np.int64), "n_tokens": np.frombuffer(counts, np.int64)})
            with fs.open_output_stream(_place(name + ".idx")[1]) as f, pa.ipc.new_stream(f, index.schema) as w:
                w.write_table(index)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([kind]), pa.array([id_type])], ["path", "part", "records", "ids", "kind", "id_type"])

    # in the order of the id's own type; ids go to Python as they are written
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc_nulls_first(), "hash"]
    rows = rows.repartitionByRange(_ranges(docs, file_bytes), *order).sortWithinPartitions(*order)
    rows = rows.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "path string, part long, records long, ids long, kind string, id_type string"), "binary-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the files of write(), checksums verified. A file's index and one record at a
    time are held."""

    def run(batches):
        for b in batches:
            for path, before, kind in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, name = _place(path)
                with fs.open_input_file(name + ".idx") as f:
                    index = pa.ipc.open_stream(f).read_all()
                total = before
                with fs.open_input_file(name + ".rec") as f:
                    for part in index.to_batches(max_chunksize=10_000):
                        starts, crcs = [], []
                        for offset, n in zip(part["offset"].to_pylist(), part["n_tokens"].to_pylist()):
                            f.seek(offset)
                            payload, _ = unframe(f.read(16 + n * int(kind[-1])), 0)
                            starts.append(total)
                            total += n
                            crcs.append(zlib.crc32(np.frombuffer(payload, dtype=kind).astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(starts, pa.int64()), part["n_tokens"], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    found = files.agg(F.count("*").alias("n"), F.max("id_type").alias("id_type")).first()
    todo = files.select("path", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("before"), "kind").repartition(max(1, found["n"]), "path")
    return todo.mapInArrow(run, f"doc_id {found['id_type'] or 'long'}, start long, n_tokens long, ids_crc32 long")


def encode_files(docs: DataFrame, end_id: int = 2, tokenizer_path: str | None = None, folder: str | None = None) -> DataFrame:
    return read(write(docs, folder or scratch(docs.sparkSession, "records"), end_id, tokenizer_path))
