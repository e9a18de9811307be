"""What queries read of stored tables, from Spark's own metrics of their scans."""

import re
import time

from pyspark.sql import SparkSession


class Reads:
    """Files and rows that the scans of tables below a folder of this name read within the block: rows are those that filters pushed to the scan could not
    skip by row groups and pages.

    with Reads(spark, "postings") as r: ...; r.files, r.rows
    """

    def __init__(self, spark: SparkSession, part: str):
        self._spark = spark
        self._store, self._part = spark._jsparkSession.sharedState().statusStore(), part
        self._conf = spark._jvm.scala.jdk.javaapi.CollectionConverters
        self.files = self.rows = self.scans = 0

    def __enter__(self) -> "Reads":
        self._length = self._spark.conf.get("spark.sql.maxMetadataStringLength")
        self._spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # so that scans tell their whole paths
        self._before = {e.executionId() for e in self._conf.asJava(self._store.executionsList())}
        return self

    def __exit__(self, *failed) -> None:
        self._spark.conf.set("spark.sql.maxMetadataStringLength", self._length)
        time.sleep(0.3)  # metrics arrive by events
        for e in self._conf.asJava(self._store.executionsList()):
            if e.executionId() in self._before:
                continue
            values = self._conf.asJava(self._store.executionMetrics(e.executionId()))
            for node in self._conf.asJava(self._store.planGraph(e.executionId()).allNodes()):
                if not node.name().startswith("Scan parquet") or not re.search(rf"/{self._part}\b", node.desc()):
                    continue
                got = {m.name(): values.get(m.accumulatorId()) for m in self._conf.asJava(node.metrics())}
                number = lambda name: int(re.sub(r"[^0-9]", "", (got.get(name) or "0").split("\n")[-1].split("(")[0]) or 0)
                self.scans += 1
                self.files += number("number of files read")
                self.rows += number("number of output rows")
