"""Facets, pages, filters, fusion and quality of collections."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by value of each column, in one pass: facet, value, n."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.lit(None)
    value = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        only = (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
        name, value = F.when(F.col("g") == only, F.lit(c)).otherwise(name), F.when(F.col("g") == only, F.col(c).cast("string")).otherwise(value)
    return sets.select(name.alias("facet"), value.alias("value"), "n")


def page(df: DataFrame, number: int, size: int, sort: str, key: str) -> DataFrame:
    """One page in the order of a column ('-' before it: descending) and a key."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("pages are numbered from 1 and hold 1 to 1000 rows")
    order = F.desc(sort[1:]) if sort.startswith("-") else F.asc(sort)
    return df.orderBy(order, key).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total_items")).select("total_items", F.ceil(F.col("total_items") / size).alias("total_pages"))


def where(df: DataFrame, organization: str | None = None, since: dict | None = None, until: dict | None = None, any_of: dict | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values, are at or after `since`, before `until`, and among `any_of`; with an organization, only its rows."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items() if v is not None]
    tests += [F.col(c) >= v for c, v in (since or {}).items()] + [F.col(c) < v for c, v in (until or {}).items()] + [F.col(c).isin(list(v)) for c, v in (any_of or {}).items()]
    if organization is not None:
        tests.append(F.col("organization_id") == organization)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def of_tenant(df: DataFrame, organization: str | None, **filters) -> DataFrame:
    """The same for one organization, which must be named."""
    if not organization:
        raise ValueError("an organization is required")
    return where(df, organization, **filters)


def fuse(sources: dict[str, DataFrame], k: int = 60, top_k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): each id once, with the sum of 1 / (k + rank) over the lists and its best rank."""
    parts = [d.select("id", "rank", F.lit(n).alias("source")) for n, d in sources.items()]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("sources"))
    return fused.orderBy(F.desc("score"), "id").limit(top_k)


def rerank(df: DataFrame, weights: dict[str, float], top_k: int = 10) -> DataFrame:
    """Weighted sum of signal columns."""
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()])
    return df.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(top_k)


def expand(tokens: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query tokens and their synonyms (token, synonym), each once."""
    more = tokens.join(synonyms, "token").select(F.col("synonym").alias("token"))
    return tokens.select("token").union(more).distinct()


def best_of_each(df: DataFrame, key: str, score: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct("*"), score).alias("__best")).select("__best.*")


def duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal texts: digest, smallest key, count."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
