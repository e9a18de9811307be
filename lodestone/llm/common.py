"""Helpers shared by the operators: tables, scratch tables in the shared folder, and hashing in numpy."""

import atexit
import functools
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only on a local master whose session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.shared.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, conf, True)
        spark.conf.set("lodestone.shared.dir", conf)
    return conf.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str = "zstd", options: dict | None = None) -> DataFrame:
    """df as a table written once in the shared folder: it cuts the lineage and outlives lost executors. options: of the writer."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).options(**options or {}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() which nothing will read again."""
    for t in tables:
        drop_path(t.sparkSession, t._lodestone_path)


def small_or_not(df: DataFrame, most: int) -> DataFrame:
    """A stored table to be broadcast if it has at most so many rows; a join with it shuffles otherwise, whatever Spark estimates."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like this one that is not taken, in whatever case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(stage):
    """A function of a table (first) that returns its columns, made to work for any column names: odd ones, as those with a dot, are replaced for it."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = list(docs.columns)
        if all(re.fullmatch(r"\w+", c) for c in names):
            return stage(docs, *args, **kwargs)
        taken, safe = list(names), []
        for i, c in enumerate(names):
            safe.append(c if re.fullmatch(r"\w+", c) else fresh(f"column_{i}", taken))
            taken.append(safe[-1])
        return stage(docs.toDF(*safe), *args, **kwargs).toDF(*names)

    return run


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5; fold 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers, another one for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
