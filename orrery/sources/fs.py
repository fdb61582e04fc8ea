"""Small files on the cluster's file system, through Hadoop's client: whatever Spark can read lies there too."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small files. Names are published by a rename within it, so that readers see a file whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, at: str = "") -> list[str]:
        """Names in the folder or one below it, sorted; hidden ones are left out."""
        p = self._path(at)
        if not self._fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(p)) if not n.startswith((".", "_")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        src = self._fs.open(self._path(name))
        try:
            return bytes(b & 0xFF for b in src.readAllBytes()).decode()
        finally:
            src.close()

    def create(self, name: str, text: str) -> bool:
        """Publish a new file; False if the name is taken."""
        tmp, final = self._path(f".new-{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.exists(final) and self._fs.rename(tmp, final):
            return True
        self._fs.delete(tmp, False)
        return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Log:
    """Numbered versions of one JSON document; the highest number is the current one, and the last few are kept."""

    def __init__(self, folder: Folder, at: str, keep: int = 5):
        self.folder, self.at, self.keep = folder, at, keep

    def numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.folder.names(self.at) if n.split(".")[0].isdigit()]

    def get(self, number: int) -> dict:
        return json.loads(self.folder.read(f"{self.at}/{number:012d}.json"))

    def last(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.get(numbers[-1])) if numbers else None

    def put(self, number: int, document: dict) -> bool:
        """Publish a version; False if another writer has published that number."""
        if not self.folder.create(f"{self.at}/{number:012d}.json", json.dumps(document, sort_keys=True)):
            return False
        for old in self.numbers()[: -self.keep]:
            self.folder.delete(f"{self.at}/{old:012d}.json")
        return True
