"""Personal data: four base patterns, and bootstrapped contextual extraction on top of them.

Base patterns give spans of kinds email, ip, card and phone (leftmost, non-overlapping per kind; matches that fail their check
are dropped). They are the seeds. Each seed, and each other candidate, is an occurrence of an instance (its text) in two lexical
patterns: the word before with the word after, and the two words before (of a word the nearest `CONTEXT` characters, digits masked).
Candidates are digit groups set apart by single spaces, dots or hyphens with 7 digits or more together, and tokens with
four digits or more or with an @; a token ends at white space, quotes, brackets and list punctuation, and may be of any length.

Spark scores the graph of patterns and instances in rounds. Seeds have confidence 1 for their kind. A pattern is trusted for a kind if
at least `support` of its distinct instances are seeds of it or were found before with a confidence of `sure`; its trust is the mean
confidence of all its distinct instances. An instance that is no seed and whose form could be of the kind (an @ for email, three
dots for ip, 13 digits for card, 7 to 15 for phone) gets the best trust among its patterns. So instances found in one round support further
patterns in the next. After `rounds` rounds, instances of at least `sure` are reported as further spans of their best kind, unless they
overlap a base span.

Spans are written kind:start:end in code points, end exclusive, by kind in the order above and then by start. A null text is
empty and has no spans. Repeated rows are each reported and count once as evidence. An empty table gives no rows. Other columns are
ignored by find(); redact() keeps them, whatever their names, and replaces each span by its kind in angle brackets (overlapping spans as one).
"""

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, plain_names, small_or_not, stored

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the base patterns: the same matches in time linear in the text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*+")
MARK = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ROWS = 200_000  # at most so many rows of patterns, instances or documents are broadcast; more are joined by a shuffle
CONTEXT = 40  # characters of a neighbouring word that a pattern holds
EDGE = frozenset("\"'`()[]{}<>|*#$&!?,;:=")
GROUPS = re.compile(r"(?<![\w@.])\(?[0-9]+\)?(?:[\x20.-]\(?[0-9]+\)?)++")
DIGITS = re.compile("[0-9]")
WORDLIKE = re.compile(r"[\w@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _octet(digits: str) -> bool:
    """At most 255, however many zeros stand before."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end), sorted."""
    out = [(0, s, e) for s, e in _emails(text)]
    if MARK.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def spans_string(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _word_before(text: str, at: int) -> tuple[str, int]:
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and end - start < CONTEXT and not text[start - 1].isspace():
        start -= 1
    return text[start:end].lower(), start


def _word_after(text: str, at: int) -> str:
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    end = at
    while end < n and end - at < CONTEXT and not text[end].isspace():
        end += 1
    return text[at:end].lower()


def _masked(word: str) -> str:
    return re.sub("[0-9]+", "#", word)


def _contexts(text: str, start: int, end: int) -> list[str]:
    b, at = _word_before(text, start)
    a, (bb, _) = _word_after(text, end), _word_before(text, at)
    return [f"{_masked(b)} _ {_masked(a)}", f"{_masked(bb)} {_masked(b)} _"]


def _ends(c: str) -> bool:
    return c.isspace() or c in EDGE


def _others(text: str, taken: list[tuple[int, int, int]]):
    """Start and end of the other candidates, in order, without those that overlap what is taken."""
    taken = sorted((s, e) for _, s, e in taken)
    merged: list[list[int]] = []
    for s, e in taken:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]

    def free(start, end):
        i = bisect.bisect_left(starts, end)
        return i == 0 or merged[i - 1][1] <= start

    groups = [m.span() for m in GROUPS.finditer(text) if len(DIGITS.findall(m[0])) >= 7 and not WORDLIKE.match(text, m.end()) and free(*m.span())]
    yield from groups
    used, at, g = groups, 0, 0
    while m := MARK.search(text, at):
        start, end = m.start(), m.end()
        while start > at and not _ends(text[start - 1]):
            start -= 1
        while end < len(text) and not _ends(text[end]):
            end += 1
        at = end
        while end > start and text[end - 1] == ".":
            end -= 1
        while start < end and text[start] == ".":
            start += 1
        while g < len(used) and used[g][1] <= start:
            g += 1
        if start < end and not (g < len(used) and used[g][0] < end) and free(start, end):
            token = text[start:end]
            if "@" in token or len(DIGITS.findall(token)) >= 4:
                yield start, end


def could_be(kind: int, token: str) -> bool:
    digits = len(DIGITS.findall(token))
    return ("@" in token, token.count(".") == 3 and digits >= 4, digits >= 13, 7 <= digits <= 15)[kind]


OCCURRENCE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("may", pa.list_(pa.int32())), ("instance", pa.binary()), ("patterns", pa.list_(pa.string()))]))


def _scan(batches):
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.slice(at, 512)
            counts, base, base_sha, occurrences = [[], [], [], []], [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in spans))
                said = spans_string(spans)
                base.append(said)
                base_sha.append(hashlib.sha256(said.encode()).hexdigest())
                found = [(s, e, k) for k, s, e in spans] + [(s, e, -1) for s, e in _others(text, spans)]
                occurrences.append([
                    {"start": s, "end": e, "kind": k, "may": [] if k >= 0 else [i for i in range(4) if could_be(i, text[s:e])], "instance": hashlib.blake2b(text[s:e].encode("utf-8", "surrogatepass"), digest_size=12).digest(), "patterns": _contexts(text, s, e)}
                    for s, e, k in found
                ])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_sha), pa.array(base), pa.array(occurrences, OCCURRENCE)],
                ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"],
            )


def _learned(scanned: DataFrame, support: int, rounds: int, sure: float) -> DataFrame:
    """(instance, learned): the kind of each discovered instance."""
    o = scanned.select(F.explode("found").alias("o")).select("o.instance", "o.kind", "o.may", F.explode("o.patterns").alias("pattern"))
    graph = stored(o.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.first("may").alias("may")), "pii-graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = graph.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("sum"), F.count("*").alias("firm"))
    edges = stored(graph.filter("kind < 0").select("pattern", "instance", F.explode("may").alias("kind")), "pii-edges")
    scores = None
    for _ in range(rounds):
        known = seeds
        if scores is not None:
            found = edges.join(small_or_not(scores, ROWS), ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("confidence").alias("sum"), F.count_if(F.col("confidence") >= sure).alias("firm"))
            known = seeds.unionByName(found).groupBy("pattern", "kind").agg(F.sum("sum").alias("sum"), F.sum("firm").alias("firm"))
        trust = stored(known.filter(F.col("firm") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / F.col("n")).alias("trust")), "pii-trust")
        scores = stored(edges.join(small_or_not(trust, ROWS), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("trust").alias("confidence")), "pii-scores")
    best = scores.filter(F.col("confidence") >= sure).groupBy("instance").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("b"))
    out = stored(best.select("instance", F.col("b.kind").alias("learned")), "pii-learned")
    drop_stored(graph, edges)
    return small_or_not(out, ROWS)


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _scanned(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", _text_hash(F.col("text")).alias("text_hash"))
    found = "array<struct<start:int,end:int,kind:int,may:array<int>,instance:binary,patterns:array<string>>>"
    return stored(rows.mapInArrow(_scan, f"doc_id {kind}, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found {found}"), "pii-found")


def _further(scanned: DataFrame, learned: DataFrame, key: list[str]) -> DataFrame:
    """The discovered spans of each row, as one array."""
    o = scanned.select(*key, F.explode("found").alias("o")).select(*key, "o.instance", "o.start", "o.end", "o.kind").filter("kind < 0")
    hits = o.join(learned, "instance").dropDuplicates([*key, "start", "end"])
    return hits.groupBy(*key).agg(F.collect_list(F.struct(F.col("learned").alias("kind"), "start", "end")).alias("further"))


def find(docs: DataFrame, support: int = 5, rounds: int = 3, sure: float = 0.9) -> DataFrame:
    """One row for each document: counts and digest of the base spans, all spans, and the count of those discovered."""
    first = _scanned(docs)
    scanned = stored(first.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    drop_stored(first)
    further = small_or_not(stored(_further(scanned, _learned(scanned, support, rounds, sure), ["row"]), "pii-further"), ROWS)
    named = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct((F.array_position(named, F.split(s, ":")[0]).cast("int") - 1).alias("kind"), F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end")))
    every = F.array_sort(F.concat(base, F.col("further")))
    said = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"], s["end"])), ",")
    return scanned.join(further, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("further").isNull(), F.col("base")).otherwise(said).alias("spans"), F.coalesce(F.size("further"), F.lit(0)).cast("long").alias("n_discovered"),
    )


def masked_text(text: str, spans) -> str:
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


@plain_names
def redact(docs: DataFrame, support: int = 5, rounds: int = 3, sure: float = 0.9) -> DataFrame:
    """docs with every span of text replaced by its kind; all columns stay, n_chars (if there) follows the text."""
    scanned = _scanned(docs)
    further = _further(scanned, _learned(scanned, support, rounds, sure), ["doc_id", "text_hash"])
    h, more = fresh("text_hash", docs.columns), fresh("further", docs.columns)
    further = small_or_not(stored(further.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("further").alias(more)), "pii-further"), ROWS)
    drop_stored(scanned)
    rows = docs.withColumn(h, _text_hash(F.col("text")))
    rows = rows.join(further, rows["doc_id"].eqNullSafe(further["of_id"]) & (rows[h] == further["of_hash"]), "left").select(*[rows[c] for c in docs.columns], more)
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), 512):
                b = whole.slice(first, 512)
                texts = [t if t is None else masked_text(t, base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in more or ()]) for t, more in zip(b.column(at).to_pylist(), b.column(width).to_pylist())]
                columns = list(b.columns[:width])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = list(docs.columns)
    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
