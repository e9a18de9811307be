"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters or of other visible characters; features are hashed unigrams and bigrams of the tokens, of
their shapes, and one for how often bigrams repeat, weighted 1 + log(count) and scaled to unit length. Training reads a
bounded sample: at most `sample` labelled rows, those of the smallest hash of doc_id, none of them held out, and of those as many,
in the order of the hash, as hold `most` features together. These stream through one task in that order, `epochs` times. The weights
(2^18 floats, most of them 0 by the proximal step) are broadcast, and whole texts are scored as sparse dot products.

Empty and null texts have only the bias and are scored like any other. Null labels teach nothing; different labels given for one id
both count, equal ones once, as do rows of documents that repeat id and text. With no labels every score is 0.5. Repeated rows are each
reported; an empty table gives no rows. keep_good() keeps all columns, whatever their names.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, fresh, mix64, plain_names, stored

BITS = 18
MEMO = 100_000  # at most so many tokens are remembered, then forgotten all at once
TOKEN = re.compile(r"\w+|[^\w\s]+")
THRESHOLD = 0.3


def _hashes(tokens: list[str], memo: dict[str, int]) -> np.ndarray:
    def new(t: str) -> int:
        if len(memo) > MEMO:
            memo.clear()
        memo[t] = h = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
        return h

    get = memo.get
    return np.fromiter((get(t) or new(t) for t in tokens), dtype=np.uint64, count=len(tokens))


def _shape(t: str) -> str:
    return "0" if t[0].isdigit() else ("X" if t.isupper() and len(t) > 1 else "Xx" if t[0].isupper() else "x") if t[0].isalpha() else t[:3]


def features(text: str | None, memo: dict[str, int], shapes: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their weights."""
    tokens = TOKEN.findall(text or "")
    bias = np.array([0], dtype=np.int64)
    if not tokens:
        return bias, np.ones(1)
    if len(shapes) > MEMO:
        shapes.clear()
    known = [shapes.get(t) or shapes.setdefault(t, _shape(t)) for t in tokens]
    w, s = _hashes(tokens, memo), _hashes(known, memo)
    parts = [mix64(w, 1), mix64(s, 2)]
    if len(tokens) > 1:
        pairs = mix64(w[:-1], 3) ^ w[1:]
        repeats = 1 - len(np.unique(pairs)) / len(pairs)
        parts += [mix64(pairs, 4), mix64(mix64(s[:-1], 5) ^ s[1:], 6), mix64(np.full(max(1, len(tokens) // 4), int(repeats * 10), dtype=np.uint64), 7)]
    index, count = np.unique(np.concatenate(parts) >> np.uint64(64 - BITS), return_counts=True)
    value = 1 + np.log(count)
    value /= np.sqrt((value * value).sum())
    keep = index != 0
    return np.concatenate([bias, index[keep].astype(np.int64)]), np.concatenate([np.ones(1), value[keep]])


def _featurise(batches):
    memo, shapes = {}, {}
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            f = [features(t, memo, shapes) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([i for i, _ in f], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in f], pa.list_(pa.float32()))], ["y", "h", "i", "v"])


def _ftrl(alpha: float, beta: float, l1: float, l2: float, epochs: int, most: int):
    def run(batches):
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        rows, held = [], 0
        for b in batches:
            for y, i, v in zip(b.column("y").to_pylist(), b.column("i"), b.column("v")):
                held += len(i)
                if held <= most:
                    rows.append((y, i.values.to_numpy().copy(), v.values.to_numpy().astype(np.float64)))

        def weights(zi, ni):
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

        for _ in range(epochs):
            for y, i, v in rows:
                zi, ni = z[i], n[i]
                w = weights(zi, ni)
                g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
                z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
                n[i] = ni + g * g
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, n).astype(np.float32).tobytes()], pa.binary())], ["w"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 8000, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, label: str = "quality", most: int = 30_000_000
) -> np.ndarray:
    """Weights, learned from a sample of at most `sample` labelled rows and `most` features: these parameters are the bound."""
    h = F.xxhash64(F.lit(11), "doc_id")
    usable = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    usable = usable.distinct().withColumn("h", h).orderBy("h", "doc_id", "y").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # `sample` rows at most
    rows = chosen.select("text", "y", "h").mapInArrow(_featurise, "y double, h long, i array<int>, v array<float>").distinct()
    rows = stored(rows.orderBy("h", "y", F.hash("i")).limit(sample), "quality-sample")
    got = rows.repartition(1).sortWithinPartitions("h", "y", F.hash("i")).mapInArrow(_ftrl(alpha, beta, l1, l2, epochs, most), "w binary").collect()  # one row
    return np.frombuffer(got[0]["w"], dtype=np.float32) if got else np.zeros(1 << BITS, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """The columns in keep, and the score under this name, for every row."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*[docs[c] for c in keep], *[docs["text"].alias(fresh("text", keep))] * ("text" not in keep))
    at = (*keep, "text").index("text")  # the text goes to Python once

    def run(batches):
        w = model.value.astype(np.float64)
        memo, shapes = {}, {}
        for b in batches:
            out = []
            for first in range(0, len(b), 256):
                for t in b.column(at).slice(first, 256).to_pylist():
                    i, v = features(t, memo, shapes)
                    out.append(1 / (1 + np.exp(-np.clip(w[i] @ v, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.float64())], names=[*keep, name])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep) + f", `{name}` double"
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8000, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, sample), ["doc_id"])
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@plain_names
def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 8000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    name = fresh("score", docs.columns)
    return score(docs, train(docs, labels, sample), docs.columns, name).filter(F.col(name) >= threshold).drop(name)
