"""Tables on disk, and tables written in the shared folder to cut a lineage."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only on a local master whose session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.shared.folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("lodestone.shared.folder", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables made by stored() which nothing will read again."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._lodestone_path)
        folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_or_not(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table to be broadcast if it has at most so many rows; a join with it shuffles otherwise."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the dependency manifests below a folder."""
    from pyspark.sql import functions as F

    names = "{requirements*.txt,pyproject.toml,setup.py,package.json,go.mod,Cargo.toml}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def folder_size_kb(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.agg(F.expr("coalesce(sum(length), 0) div 1024").alias("size_kb"))
