"""Vectors: choice of chunk texts, stub embeddings, the embedding fold, cosine search."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import DIMENSIONS, as_doubles, cosine, stub_embedding
from ..functions.text import strip, words
from .search import check

MODEL, PREVIEW = "stub-128", 200  # fixed value: characters of a preview
VECTORS, QUERIES = 8192, 1024  # of a block


def chunk_texts(document_id: Column, previews: Column, preview: Column, count: Column) -> Column:
    """The texts to embed: the chunk previews; else the text preview cut in `count` windows, the last one longer; else placeholders."""
    blank = lambda i: F.concat_ws(":", document_id, F.lit("chunk"), i.cast("string"))
    given = F.transform(previews, lambda c, i: F.coalesce(F.nullif(strip(c), F.lit("")), blank(i)))
    n = F.greatest(F.coalesce(count, F.lit(1)), F.lit(1))
    w = words(preview)
    step = F.greatest(F.floor(F.size(w) / n), F.lit(1)).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    cut = F.transform(at, lambda i: F.array_join(F.slice(w, i * step + 1, F.when(i == n - 1, F.greatest(F.size(w), F.lit(1))).otherwise(step)), " "))
    return F.when(F.size(F.coalesce(previews, F.array().cast("array<string>"))) > 0, given).when(F.length(F.coalesce(preview, F.lit(""))) > 0, cut).otherwise(F.transform(at, blank))


def embed(documents: DataFrame) -> DataFrame:
    """One row for each chunk of documents (document_id, texts); other columns are kept."""
    rest = [c for c in documents.columns if c not in ("document_id", "texts")]
    each = documents.select("document_id", *rest, F.posexplode("texts").alias("chunk_index", "text"))
    return each.select("document_id", *rest, "chunk_index", F.substring("text", 1, PREVIEW).alias("text_preview"), F.lit(MODEL).alias("model_name"), F.lit(DIMENSIONS).alias("vector_dim"), stub_embedding(F.col("text")).alias("vector"))


def fold(events: DataFrame) -> DataFrame:
    """One row for each chunk of each document processed (the last event of a document counts), with its vector."""
    e = events.filter(F.col("eventType") == "DocumentProcessed").withColumn("id", F.get_json_object("payload", "$.documentId"))
    last = e.groupBy("id").agg(F.max_by(F.struct("payload", "organizationId"), F.struct("timestamp", "eventId")).alias("e")).select("id", "e.*")
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    previews = F.from_json(get("chunkPreviews"), "array<string>")
    texts = chunk_texts(F.col("id"), previews, get("textPreview"), get("chunkCount").cast("int"))
    return embed(last.select(F.col("id").alias("document_id"), get("repositoryId").alias("repository_id"), F.col("organizationId").alias("organization_id"), texts.alias("texts")))


def search_text(chunks: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """The chunks nearest to the vector of a text: document_id, chunk_index, preview, score; ties by document and chunk."""
    check("top_k", top_k, 1, 50)
    q = F.broadcast(chunks.sparkSession.range(1).select(stub_embedding(F.lit(query)).alias("q")))  # one row
    score = F.round(cosine(F.col("vector"), F.col("q")), 6)
    return chunks.crossJoin(q).select("document_id", "chunk_index", F.col("text_preview").alias("preview"), score.alias("score")).orderBy(F.desc("score"), "document_id", "chunk_index").limit(top_k)


def top_similar(vectors: DataFrame, query: list[float], top_k: int = 5) -> DataFrame:
    """id, score of the nearest by cosine to one vector."""
    check("top_k", top_k, 1, 50)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(cosine(F.col("vector"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(top_k)


def _packed(key, t):
    ids = t["id"].combine_chunks()
    data = t["vector"].combine_chunks().flatten().to_numpy()
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.ListArray.from_arrays([0, len(ids)], ids), "hashes": pa.array([t["hash"].to_numpy().tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})


def _nearest(top_k: int):
    """The nearest of each query of a block among the vectors of another, which are held once for all query blocks that meet it. Equal ids are known by
    their hashes first; rows are in the order of their ids."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                dim, hashes, data, q_hashes, q_data = (b.column(c)[i].as_py() for c in ("dim", "hashes", "data", "q_hashes", "q_data"))
                ids, q_ids = b.column("ids")[i].values, b.column("q_ids")[i].values
                v, q = (np.frombuffer(x).reshape(-1, dim) for x in (data, q_data))
                lengths = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.round(q @ v.T / lengths, 6)
                if ids.type == q_ids.type:
                    for x, y in zip(*np.nonzero(np.frombuffer(q_hashes, np.int64)[:, None] == np.frombuffer(hashes, np.int64))):
                        score[x, y] = -np.inf if ids[y.item()] == q_ids[x.item()] else score[x, y]
                score[~np.isfinite(score)] = -np.inf
                own, found, values = [], [], []
                for x, row in enumerate(score):
                    at = np.flatnonzero(row >= (np.partition(row, -top_k)[-top_k] if len(row) > top_k else -2))
                    at = at[row[at] >= -2]
                    at = at[np.argsort(-row[at], kind="stable")][:top_k]
                    own.append(np.full(len(at), x))
                    found.append(at)
                    values.append(row[at])
                own, found, values = np.concatenate(own), np.concatenate(found), np.concatenate(values)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(own)), ids.take(pa.array(found)), pa.array(values)], ["query_id", "id", "score"])

    return run


def top_similar_many(vectors: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """The nearest by cosine of each query (query_id, vector) among all vectors (id, vector) but its own: query_id, rank, id, score. Ids are of any type
    that can be ordered (numbers, strings, structs of them). Queries and vectors meet in blocks of bounded size, and each pair of blocks hands on
    top_k rows of a query. Vectors of zeros and of other dimensions, and rows without id or vector, take no part."""

    def blocks(df: DataFrame, id_: str, size: int) -> tuple[DataFrame, int, str]:
        kind = df.schema[id_].dataType.simpleString()
        rows = df.select(F.col(id_).cast(kind).alias("id"), as_doubles(F.col("vector")).alias("vector")).filter("id is not null and size(vector) > 0 and forall(vector, x -> x is not null)")
        n = max(1, -(-df.count() // size))
        h = F.xxhash64("id")
        dealt = rows.withColumns({"hash": h, "dim": F.size("vector"), "block": F.pmod(h, F.lit(n)).cast("int")}).repartition("dim", "block").sortWithinPartitions("dim", "block", "id")
        return dealt.groupBy("dim", "block").applyInArrow(_packed, f"dim int, block int, ids array<{kind}>, hashes binary, data binary"), n, kind

    (every, n, kind), (asked, _, q_kind) = blocks(vectors, "id", VECTORS), blocks(queries, "query_id", QUERIES)
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("hashes").alias("q_hashes"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    met = every.join(asked, ["dim", "block"]).select("dim", "ids", "hashes", "data", "q_ids", "q_hashes", "q_data")
    found = met.mapInArrow(_nearest(top_k), f"query_id {q_kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def records(embeddings: DataFrame, repository_id: str | None = None, include_vectors: bool = False) -> DataFrame:
    out = embeddings if repository_id is None else embeddings.filter(F.col("repository_id") == repository_id)
    return out if include_vectors else out.drop("vector")
