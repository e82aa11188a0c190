"""Numbered commits: each a small file that lists what is visible from then on.

A commit is written under a name of its own and then renamed to its number
without overwriting, so of two writers of one number the second is told. How
strictly is up to the file system's rename: HDFS does it in one step; a store
that copies instead leaves a short gap.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ENDING = ".json"


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._hadoop.Path(path).getFileSystem(self._conf)

    def _at(self, name: str) -> Any:
        return self._files.makeQualified(self._hadoop.Path(self.path, name))

    def times(self) -> dict[int, int]:
        """Every commit's number, with its time in milliseconds."""
        folder = self._hadoop.Path(self.path)
        if not self._files.exists(folder):
            return {}
        listed = [(f.getPath().getName(), f.getModificationTime()) for f in self._files.listStatus(folder)]
        return {int(n.removesuffix(ENDING)): at for n, at in listed if n.endswith(ENDING)}

    def entries(self, number: int) -> list[dict]:
        """What commit ``number`` lists; nothing before the first one."""
        if number == 0:
            return []
        stream = self._files.open(self._at(f"{number}{ENDING}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, list[dict]]:
        number = max(self.times(), default=0)
        return number, self.entries(number)

    def put(self, number: int, entries: list[dict]) -> bool:
        """Write commit ``number`` if nobody else has; tell whether it was."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        plainly = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(draft, self._at(f"{number}{ENDING}"), plainly)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def forget(self, number: int) -> None:
        self._files.delete(self._at(f"{number}{ENDING}"), False)
