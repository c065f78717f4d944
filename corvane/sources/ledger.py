"""A small state beside a table, in numbered files: each commit is a new file that exists once, so no writer loses another's."""

from __future__ import annotations

import copy
import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

EMPTY = {"records": [], "current": None, "meta": {}}
#: Commits that are tried before a writer gives up, and older files that are kept.
TRIES, KEPT = 50, 20


class Ledger:
    """The records of a root's versions, which of them is current, and the metadata that goes with it.

    A commit reads the newest file, changes its state and creates the next number; if another writer was first, it starts
    again from what that one wrote. Creating a file that must not exist yet is the only step that others see.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/manifest"

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, files = self._path()
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        """(number, state) of the newest commit; 0 and the empty state where there is none."""
        for _ in range(TRIES):
            numbers = self._numbers()
            if not numbers:
                return 0, copy.deepcopy(EMPTY)
            path, files = self._path(f"{numbers[-1]:020d}.json")
            stream = files.open(path)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return numbers[-1], json.loads(text)
            except ValueError:  # its writer is still at it
                time.sleep(0.1)
        raise RuntimeError(f"{self.folder} has an unreadable commit")

    def _create(self, number: int, text: str) -> bool:
        """Whether this call made the file of a number."""
        path, files = self._path(f"{number:020d}.json")
        local = files.makeQualified(path).toUri()
        if local.getScheme() == "file":
            target = local.getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            own = f"{target}.{uuid.uuid4().hex}"
            with open(own, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(own, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Apply a change to the newest state and make it the next one; ``change`` may run several times."""
        for _ in range(TRIES):
            number, state = self.read()
            new = change(copy.deepcopy(state))
            if self._create(number + 1, json.dumps(new)):
                for old in self._numbers()[:-KEPT]:
                    path, files = self._path(f"{old:020d}.json")
                    files.delete(path, False)
                return new
        raise RuntimeError(f"{TRIES} commits to {self.folder} were overtaken")
