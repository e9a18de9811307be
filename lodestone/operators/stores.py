"""The stores of the knowledge base as durable keyed tables: repositories, documents with chunks, nodes with edges, chunk vectors.

Each is a sources.keyed.Store in a folder; every method is one change, seen whole or not at all.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_url
from ..sources import schemas
from ..sources.keyed import Delete, DeleteWhere, Keyed, Merge, Store, add, patch, upsert
from . import folds, vectors

PROCESSED = "document_id string, repository_id string, file_name string, document_type string, word_count int, text_preview string, chunk_count int"
VECTOR = "document_id string, chunk_index int, repository_id string, organization_id string, text_preview string, model_name string, vector_dim int, vector array<double>"


class Repositories(Store):
    """Repositories by id. A url belongs to one repository: of several that are inserted with it the one created first, then of the smallest id."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder, {"repositories": Keyed(schemas.REPOSITORY, ("repository_id",), buckets=buckets), "urls": Keyed("url string, repository_id string", ("url",), buckets=buckets)})

    def insert(self, rows: DataFrame) -> int:
        """Rows with a valid url that no other repository holds, and an id that is not there."""
        valid = rows.filter(valid_url(F.col("url")) & F.col("repository_id").isNotNull())
        first = valid.groupBy("url").agg(F.min_by(F.struct("*"), F.struct("created_at", "repository_id")).alias("r")).select("r.*")
        new = first.join(self.read("urls"), "url", "left_anti").join(self.read("repositories"), "repository_id", "left_anti")
        return self.apply(add("repositories", new), add("urls", new.select("url", "repository_id")))

    def update(self, changes: DataFrame) -> int:
        """Patches columns of repositories that are there; null changes nothing. The url stays."""
        return self.apply(patch("repositories", changes.drop("url", "created_at")))

    def delete(self, ids: DataFrame) -> int:
        return self.apply(Delete("repositories", ids.select("repository_id")), DeleteWhere("urls", "repository_id", ids.select("repository_id")))


class Documents(Store):
    """Documents by id, and their chunks by document and index."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder, {"documents": Keyed(PROCESSED, ("document_id",), buckets=buckets), "chunks": Keyed(schemas.CHUNK, ("document_id", "chunk_index"), ("document_id",), buckets)})

    def put(self, files: DataFrame) -> int:
        """Files (document_id, repository_id, file_name, content), an id once: the document is replaced, and all its chunks by those of the new text."""
        made = folds.process(files)
        return self.apply(upsert("documents", made), Delete("chunks", made.select("document_id")), upsert("chunks", folds.chunk_rows(made)))

    def delete(self, ids: DataFrame) -> int:
        keys = ids.select("document_id")
        return self.apply(Delete("documents", keys), Delete("chunks", keys))

    def delete_repositories(self, ids: DataFrame) -> int:
        """The documents of repositories (repository_id), with their chunks."""
        own = self.read("documents").join(ids.select("repository_id").distinct(), "repository_id", "left_semi").select("document_id")
        return self.apply(DeleteWhere("documents", "repository_id", ids.select("repository_id")), Delete("chunks", own))


class Graph(Store):
    """Nodes by id; edges by their ends and type, bucketed by the end they leave."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder, {"nodes": Keyed(schemas.NODE, ("node_id",), buckets=buckets), "edges": Keyed(schemas.EDGE, ("from_id", "to_id", "type"), ("from_id",), buckets)})

    def merge_nodes(self, nodes: DataFrame) -> int:
        """Properties are patched one by one, and nulls never overwrite; the label and the first time stay, the last time moves on."""
        return self.apply(_nodes(nodes))

    def merge_edges(self, edges: DataFrame) -> int:
        """Edges whose ends are both there; the first write counts."""
        ids = self.read("nodes").select("node_id")
        there = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
        return self.apply(Merge("edges", there.groupBy("from_id", "to_id", "type").agg(F.min("created_at").alias("created_at")), default=F.least))

    def detach_delete(self, ids: DataFrame) -> int:
        """Nodes (node_id) and all edges at them."""
        keys = ids.select("node_id")
        return self.apply(Delete("nodes", keys), Delete("edges", keys.select(F.col("node_id").alias("from_id"))), DeleteWhere("edges", "to_id", keys))


def _nodes(nodes: DataFrame) -> Merge:
    kept = lambda m: F.map_filter(F.coalesce(m, F.expr("map()").cast("map<string,string>")), lambda k, v: v.isNotNull())
    over = lambda old, new: F.map_concat(F.map_filter(kept(old), lambda k, v: ~F.map_contains_key(kept(new), k)), kept(new))
    rows = nodes.withColumn("props", kept(F.col("props")))
    return Merge("nodes", rows, {"props": over, "label": lambda old, new: old, "created_at": F.least, "updated_at": F.greatest}, order=("updated_at",))


class Vectors(Store):
    """Chunk vectors by document and chunk."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder, {"vectors": Keyed(VECTOR, ("document_id", "chunk_index"), ("document_id",), buckets)})

    def put(self, rows: DataFrame) -> int:
        """Vectors of chunks; the other chunks of their documents go."""
        return self.apply(Delete("vectors", rows.select("document_id")), upsert("vectors", rows))

    def delete(self, ids: DataFrame) -> int:
        return self.apply(Delete("vectors", ids.select("document_id")))

    def search_text(self, query: str, top_k: int = 5, repository_id: str | None = None) -> DataFrame:
        own = self.read("vectors")
        return vectors.search_text(own if repository_id is None else own.filter(F.col("repository_id") == repository_id), query, top_k)

    def search_many(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """The chunks nearest to each query (query_id, vector): query_id, rank, id (document_id, chunk_index), score."""
        return vectors.top_similar_many(self.read("vectors").select(F.struct("document_id", "chunk_index").alias("id"), "vector"), queries, top_k)
