"""Numbered manifests in a folder: the one step by which a change of stored tables becomes visible.

A manifest is a small JSON file that names the data folders which count. It is written beside and renamed to its number, which fails if
another writer has taken that number. Data folders have names of their own for each attempt, so a writer that dies leaves only folders that no
manifest names; vacuum() deletes these. On HDFS and local file systems the rename is what makes a change whole; an object store
needs a file system layer with a rename that does not overwrite.
"""

import json
import time
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("versions").getFileSystem(self._conf)

    def names(self, below: str) -> list[str]:
        path = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("versions") if n.endswith(".json") and n[0].isdigit()]

    def load(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"versions/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """Number and content of the last manifest; 0 and nothing where there is none."""
        numbers = self.numbers()
        return (max(numbers), self.load(max(numbers))) if numbers else (0, {})

    def commit(self, number: int, content: dict) -> bool:
        """Makes this the manifest of a number; False if another writer has it."""
        draft = self._path(f"versions/draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(self._fs().makeQualified(draft), self._fs().makeQualified(self._path(f"versions/{number:012d}.json")), options)
            return True
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def fresh(self) -> str:
        """The name of a data folder that no other attempt has."""
        return uuid.uuid4().hex

    def vacuum(self, used, keep: int = 2, older_than: float = 3600.0) -> int:
        """Deletes all manifests but the last `keep`, and the data folders that none of these names (used: a manifest's folders) and that are older
        than so many seconds, so that writers at work keep theirs. Returns how many folders went."""
        numbers = sorted(self.numbers())
        held = {f for n in numbers[-keep:] for f in used(self.load(n))}
        for n in numbers[:-keep]:
            self._fs().delete(self._path(f"versions/{n:012d}.json"), False)
        gone = 0
        for name in self.names("data"):
            if name not in held and self._fs().getFileStatus(self._path(f"data/{name}")).getModificationTime() / 1000 <= time.time() - older_than:
                gone += bool(self._fs().delete(self._path(f"data/{name}"), True))
        return gone
