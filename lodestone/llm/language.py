"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and every run of anything else becomes one space; n-grams of 1 to 4 characters are hashed
to 65,536 buckets. Counts for each language are summed in Spark over a bounded sample of labelled rows (`per_lang` rows of a
language are expected in it, chosen by a hash of doc_id; held-out rows never; of more than `most_langs` languages those with the most
rows are learned). The smoothed log-probability matrix has 65,536 rows and a column for each language and is broadcast, with the
log of each language's share of the labelled rows as its prior. Texts are scored in batches: the n-grams of many texts make a sparse matrix
of texts by buckets, whose product with the matrix gives all their scores at once; a long text goes in pieces that add up. The language is
the one with the greatest sum of the log-probabilities of all n-grams and the log prior. The score says how sure that is: its posterior with the
mean log-probability taken for 32 n-grams, since the posterior of whole texts is 0 or 1 throughout.

A text that is null or has no letter gets `und` and score 0. Ties go to the language that sorts first. Null languages teach
nothing; with no labelled row at all every text gets `und`. Repeated rows are each reported and taught; an empty table gives no rows. Other
columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, mix64

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PIECE = 200_000
NOT_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str | None) -> str:
    s = NOT_LETTERS.sub(" ", (text or "").lower())
    return f" {s.strip()} " if any(map(str.isalpha, s)) else ""


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers of the n-grams of some characters."""
    key = codes[: max(0, len(codes) - n + 1)].copy()
    for i in range(1, n):
        more = codes[i : len(codes) - n + 1 + i]
        key = key * np.uint64(0x110000) + more if n < 4 else (key << np.uint64(16)) ^ more
    return (mix64(key, n) >> np.uint64(48)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(text: str):
    """Bucket numbers of the n-grams of a text, for each order and piece."""
    codes = _codes(text)
    for n in ORDERS:
        for at in range(0, max(0, len(codes) - n + 1), PIECE):
            yield _hashed(codes[at : at + PIECE + n - 1], n)


def totals(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sums of the rows of the matrix that its n-grams meet, and how many n-grams it has."""
    sums, counts = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), dtype=np.int64)
    parts, owners, held = [], [], 0

    def flush():
        codes, owner = np.concatenate(parts), np.concatenate(owners)
        for n in ORDERS:
            whole = owner[: max(0, len(codes) - n + 1)] == owner[n - 1 :]  # n-grams that lie within a text
            text = owner[: len(whole)][whole]
            bucket = _hashed(codes, n)[whole]
            counts[:] += np.bincount(text, minlength=len(texts))
            for i in range(matrix.shape[1]):
                sums[:, i] += np.bincount(text, weights=matrix[:, i][bucket], minlength=len(texts))

    for i, t in enumerate(texts):
        codes = _codes(t)
        if len(codes) > PIECE:
            for g in _grams(t):
                counts[i] += len(g)
                sums[i] += [matrix[:, j][g].sum() for j in range(matrix.shape[1])]
            continue
        parts.append(codes)
        owners.append(np.full(len(codes), i, dtype=np.int64))
        held += len(codes)
        if held > PIECE:
            flush()
            parts, owners, held = [], [], 0
    if held:
        flush()
    return sums, counts


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for g in _grams(_letters(text)):
                total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                total[lang] += np.bincount(g, minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame, per_lang: int = 2500, smoothing: float = 0.5, most_langs: int = 200) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix of log-probabilities, buckets by languages, and the log priors. The sample is bounded by per_lang and most_langs."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    sizes = {r["lang"]: r["n"] for r in most}
    if not sizes:
        return [], np.zeros((BUCKETS, 0)), np.zeros(0)
    shares = spark.createDataFrame([(lang, min(1 << 30, (1 << 30) * per_lang // n)) for lang, n in sizes.items()], "lang string, share long")
    chosen = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < F.col("share")
    sample = rows.join(F.broadcast(shares), "lang").filter(chosen).select("text", "lang")  # most_langs rows
    counted = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    counts = np.zeros((BUCKETS, len(langs)))
    got = counted.toPandas()  # at most buckets x languages rows
    if len(got):
        counts[got["bucket"].to_numpy(), got["lang"].map(langs.index).to_numpy()] = got["n"].to_numpy()
    counts += smoothing
    n = np.array([sizes[x] for x in langs])
    return langs, np.log(counts / counts.sum(axis=0)), np.log(n / n.sum())


def decide(sums: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most likely class of each text, and its score."""
    best = (sums + prior).argmax(axis=1)
    p = sums / np.maximum(counts, 1)[:, None] * 32 + prior
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return best, p[np.arange(len(best)), best] / p.sum(axis=1)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, prior: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = docs.sparkSession.sparkContext.broadcast((np.asfortranarray(matrix), prior))  # 65,536 x languages doubles

    def score(batches):
        matrix, prior = model.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = [_letters(t) if langs else "" for t in part.column(1).to_pylist()]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                some = [i for i, t in enumerate(texts) if t]
                if some:
                    for i, best, sure in zip(some, *(x.tolist() for x in decide(*totals([texts[i] for i in some], matrix), prior))):
                        names[i], scores[i] = langs[best], sure
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", (fold_of(F.col("doc_id")) == 0).alias("held_out"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = 2500, most_langs: int = 200) -> DataFrame:
    return predict(docs, *train(docs, per_lang, most_langs=most_langs))
