"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased, every run of ASCII characters that are neither letters nor digits becomes one space,
and characters are the UTF-8 bytes of the result. Items are cut into windows of up to 96 characters, half a window apart (the last
one ends with the item). A window of m characters has an edit budget k = m // 10, lowered where the lemma would need no shared q-gram. A
place that matches within k edits shares at least m - q + 1 - k q of the window's q-grams (q = 8), all within k + 1
neighbouring diagonals, hence within one of the overlapping bands of 2 (k + 1) diagonals. Hits are counted by window and band, bands
that reach the bound are retained, and each retained region is verified by a banded alignment of the whole window.

Verbatim quotes need not cover a window: any 13 consecutive words of an item, and any 64 consecutive characters, are found wherever they
begin. All q-grams of such a quote are in the index, so only unbroken runs of shared q-grams are looked at; in these, each 13 words
and each 56 characters are looked up among the digests of the items' (56 characters start every 9 in an item, so that 64 hold one) and
compared with the item. Quotes with edits are found if they cover a window, which 143 characters always do.

Items shorter than q characters after normalisation hold no q-gram: find() looks them up exactly, as whole words. clean() lets such items
pass (`shortest`), since an answer of one common word stands in half of all clean documents.

One row for each row of docs and row of the benchmark with at least one verified window, quote or short item: doc_id, item_id, windows
matched, first start and last end in the normalised text, least edits; start and end are those of the quotes or the short item, and edits 0,
if no window matched. Documents that match nothing have no row. Null and empty texts match nothing. Equal rows of the benchmark count
once, rows of one item_id with several texts each for itself; rows without an id or a text, or whose text has neither letter nor digit, match
nothing. Ids may be of any type. An empty benchmark gives no rows.

The benchmark is broadcast in blocks of at most `block_bytes` of text (an index of 8 MB takes some 400 MB), one pass over the documents
for each block; hits of a document are expanded HITS at a time. clean() keeps documents that match no item, with all their columns.
"""

import hashlib
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_stored, plain_names, stored

Q, WINDOW, FILTER_BITS = 8, 96, 20
HITS = 1 << 20  # of a document, expanded at once
REACH = WINDOW + 2 * (WINDOW // 10 + 1)  # no band holds hits farther apart
WORDS, QUOTE, STEP = 13, 64, 9  # of verbatim quotes
PIECE = QUOTE - STEP + 1
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(SPACED).split())


def windows(item: bytes) -> list[bytes]:
    if len(item) < Q:
        return []
    last = max(0, len(item) - WINDOW)
    return [item[i : i + WINDOW] for i in sorted({*range(0, last, WINDOW // 2), last})]


def budget(m: int) -> int:
    return min(m // 10, (m - Q) // Q)


def quotes(b: bytes, step: int):
    """Start and end of each 13 words, and of 56 characters every `step`."""
    words: deque = deque(maxlen=WORDS)
    for m in re.finditer(rb"[^ ]+", b):
        words.append(m.start())
        if len(words) == WORDS:
            yield words[0], m.end()
    last = len(b) - PIECE
    if len(b) >= (QUOTE if step > 1 else PIECE):
        yield from ((i, i + PIECE) for i in range(0, last, step))
        yield last, last + PIECE


def _digest(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")


def _grams(b: bytes) -> np.ndarray:
    if len(b) < Q:
        return np.zeros(0, dtype=np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, dtype=np.uint8), Q)).view(np.uint64)[:, 0]


def _spot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


class Index:
    """The q-grams of a block of items, with a filter in front."""

    def __init__(self, items: list[tuple]):
        by_text: dict[bytes, list[int]] = {}
        whole: dict[bytes, list[int]] = {}
        for i, (_, text) in enumerate(items):
            whole.setdefault(normal(text), []).append(i)
        for text, at in whole.items():
            for w in windows(text):
                by_text.setdefault(w, []).extend(at)
        self.ids = [i for i, _ in items]
        self.windows = list(by_text)
        self.owners = [sorted(set(v)) for v in by_text.values()]
        self.budget = np.array([budget(len(w)) for w in self.windows], dtype=np.int64)
        self.need = np.array([len(w) - Q + 1 - Q * budget(len(w)) for w in self.windows], dtype=np.int64)
        sizes = np.array([len(w) - Q + 1 for w in self.windows], dtype=np.int64)
        flat = np.empty(sizes.sum(), dtype=np.uint64)
        ends = np.cumsum(sizes)
        for w, a, b in zip(self.windows, ends - sizes, ends):
            flat[a:b] = _grams(w)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.window = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.place = (np.arange(len(flat)) - np.repeat(ends - sizes, sizes)).astype(np.uint8)[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.grams, self.first = flat[first], first
        self.count = np.diff(np.append(first, len(flat)))
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[_spot(self.grams).astype(np.int64)] = True
        self.short = {t: at for t, at in whole.items() if 0 < len(t) < Q}
        self.texts, self.holders = list(whole), list(whole.values())
        self.shortest, parts = 0, [np.zeros(0, np.uint64)]
        for t in self.texts:
            least, digests = 0, []
            for a, b in quotes(t, STEP):
                least = min(least or len(t), b - a)
                digests.append(_digest(t[a:b]))
            parts.append(np.unique(np.array(digests, dtype=np.uint64)))
            self.shortest = min(self.shortest or least, least) if least else self.shortest
        digests, source = np.concatenate(parts), np.repeat(np.arange(len(self.texts), dtype=np.int32), [len(p) for p in parts[1:]])
        order = np.argsort(digests, kind="stable")
        self.digests, self.source = digests[order], source[order]

    def shared(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where q-grams of the items start in the text, and their numbers."""
        g = _grams(text)
        at = np.flatnonzero(self.filter[_spot(g).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        j = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[j] == g[at]
        return at[hit], j[hit]

    def quoted(self, text: bytes, at: np.ndarray) -> dict[int, list[int]]:
        """item number: start and end of what is quoted verbatim."""
        out: dict[int, list[int]] = {}
        if not self.shortest or len(at) < self.shortest - Q + 1:
            return out
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
        long = ends - starts >= self.shortest - Q + 1
        for first, last in zip(at[starts[long]].tolist(), at[ends[long] - 1].tolist()):
            run = text[first : last + Q]
            for a, b in quotes(run, 1):
                d = np.uint64(_digest(run[a:b]))
                for s in self.source[np.searchsorted(self.digests, d) : np.searchsorted(self.digests, d, "right")].tolist():
                    if run[a:b] in self.texts[s]:
                        for i in self.holders[s]:
                            e = out.setdefault(i, [first + a, first + b])
                            e[:] = min(e[0], first + a), max(e[1], first + b)
        return out

    def regions(self, text: bytes, at: np.ndarray, j: np.ndarray):
        """(window, lowest and highest diagonal) of the bands that reach the bound; the hits of a band lie within REACH, so they are expanded in
        slices that overlap by it."""
        if not len(at) or len(at) < self.need.min():
            return
        ends = np.cumsum(self.count[j])
        start = 0
        while start < len(at):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + HITS, "right")))
            first = int(np.searchsorted(at, at[start] - REACH))
            yield from self._bands(text, at[first:stop], j[first:stop])
            start = stop

    def _bands(self, text: bytes, at: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int]]:
        n = self.count[j]
        entry = np.repeat(self.first[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w, diagonal = self.window[entry], np.repeat(at, n) - self.place[entry]
        del entry
        enough = (np.bincount(w, minlength=len(self.windows)) >= self.need)[w]
        w, diagonal = w[enough].astype(np.int64), diagonal[enough] + WINDOW  # never negative
        half = self.budget[w] + 1
        key = w * (len(text) + 3 * WINDOW) + diagonal // half
        key, n = np.unique(key, return_counts=True)
        w, band = np.divmod(key, len(text) + 3 * WINDOW)
        # a band is two neighbouring halves: each half counts in two bands
        two = n.copy()
        next_ = np.flatnonzero(key[1:] == key[:-1] + 1)
        two[next_] += n[next_ + 1]
        first = np.zeros(len(key), dtype=bool)
        first[next_] = True
        keep = two >= self.need[w]
        half = self.budget[w] + 1
        low = band * half - WINDOW
        return list(zip(w[keep].tolist(), low[keep].tolist(), (low + np.where(first, 2, 1) * half)[keep].tolist()))

    def whole_words(self, text: bytes) -> dict[int, list[int]]:
        """item number: first start and last end of a short item."""
        out: dict[int, list[int]] = {}
        most = max((t.count(b" ") + 1 for t in self.short), default=0)
        last: deque = deque(maxlen=most)
        for m in re.finditer(rb"[^ ]+", text) if most else ():
            last.append(m.start())
            for start in last:
                if m.end() - start < Q:
                    for i in self.short.get(text[start : m.end()], ()):
                        e = out.setdefault(i, [start, m.end()])
                        e[1] = m.end()
        return out

    def matches(self, text: bytes, shortest: int = 0) -> dict[int, list[int]]:
        """item number: windows, start, end, least edits; of items of less than `shortest` characters none."""
        out: dict[int, list[int]] = {}
        done: set[int] = set()
        at, j = self.shared(text)
        for w, low, high in self.regions(text, at, j):
            if w in done:
                continue
            pattern, k = self.windows[w], int(self.budget[w])
            start = max(0, low - k)
            region = text[start : high + len(pattern) + k]
            found = region.find(pattern)
            edits, end = (0, found + len(pattern)) if found >= 0 else banded(pattern, region, k)
            if edits <= k:
                done.add(w)
                for i in self.owners[w]:
                    e = out.setdefault(i, [0, start + end - len(pattern), start + end, edits])
                    e[:] = e[0] + 1, min(e[1], max(0, start + end - len(pattern))), max(e[2], start + end), min(e[3], edits)
        for i, (start, end) in self.quoted(text, at).items():
            out.setdefault(i, [0, start, end, 0])
        if shortest < Q and self.short:
            out |= {i: [0, start, end, 0] for i, (start, end) in self.whole_words(text).items() if end - start >= shortest}
        return out


def banded(pattern: bytes, region: bytes, k: int) -> tuple[int, int]:
    """Least edits of the pattern against any part of the region, and where that part ends."""
    t = np.frombuffer(region, dtype=np.uint8)
    j = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for i, c in enumerate(pattern):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (t != c)]))
        row = np.minimum.accumulate(new - j) + j
        if row.min() > k:
            return k + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def blocks(benchmark: DataFrame, block_bytes: int = 8 << 20) -> list[Index]:
    """The items in blocks whose text is bounded; normally one."""
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("s")).first()["s"]
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for i in range(n):
        some = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Index([(r["item_id"], r["text"]) for r in some.collect()])


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id {dict(benchmark.dtypes)['item_id']}, n_windows long, start long, end long, edits long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    for index in blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            x = held.value
            ids = pa.array(x.ids, item_type)
            for b in batches:
                rows = [(at, i, *m) for at, text in enumerate(b.column(1).to_pylist()) for i, m in x.matches(normal(text)).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows])), ids.take(pa.array([r[1] for r in rows])), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(2, 6)]], ["doc_id", "item_id", "n_windows", "start", "end", "edits"])

        parts.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@plain_names
def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, shortest: int = Q) -> DataFrame:
    """The rows of docs in which no item of at least `shortest` characters is found. With several blocks of items the table is stored between them, so
    that a task holds the index of one."""
    at, before = docs.columns.index("text"), None
    for n, index in enumerate(blocks(benchmark, block_bytes)):
        if n:
            docs = stored(docs, "clean")
            if before is not None:
                drop_stored(before)
            before = docs
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in batches:
                keep = pa.array([not held.value.matches(normal(t), shortest) for t in b.column(at).to_pylist()], pa.bool_())
                yield b.filter(keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
