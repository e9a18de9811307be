"""String and vector similarity."""

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

DIMENSIONS = 128


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, null beyond `most`; the length gate stands first."""
    d = F.levenshtein(a, b, most)
    return F.when(F.abs(F.length(a) - F.length(b)) <= most, F.when(d >= 0, d))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used: set[int] = set()
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    j = jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return j + same * weight * (1 - j) if j else 0.0


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _stub_length(digest: Column) -> Column:
    """The length of the 128 numbers of a digest (hex). Their squares are added one after another, each by one multiplication and addition that is rounded
    once, as the SQL engine does it: else the last bit differs, and with it what a value that is a half is rounded to."""

    @F.pandas_udf(DoubleType())
    def run(digests: pd.Series) -> pd.Series:
        number = [b / 255 * 2 - 1 for b in range(256)]

        def length(d):
            total = 0.0
            for x in [number[b] for b in bytes.fromhex(d)] * 4:
                total = math.fma(x, x, total)
            return math.sqrt(total)

        return digests.map(length, na_action="ignore").astype("float64")

    return run(digest)


def stub_embedding(text: Column) -> Column:
    """A unit vector of 128 numbers from the 32 bytes of the text's SHA-256, repeated and scaled to [-1, 1]."""
    digest = F.sha2(text.cast("binary"), 256)
    starts = F.sequence(F.lit(1), F.lit(63), F.lit(2))
    # the digest and the length stand outside of what runs for each byte
    bytes_ = F.transform(F.arrays_zip(F.array_repeat(digest, 32).alias("d"), starts.alias("i")), lambda p: F.conv(F.substring(p["d"], p["i"], F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    unit = F.transform(F.arrays_zip(bytes_.alias("x"), F.array_repeat(_stub_length(digest), 32).alias("n")), lambda p: p["x"] / p["n"])
    return F.when(text.isNotNull(), F.flatten(F.array_repeat(unit, DIMENSIONS // 32)))
