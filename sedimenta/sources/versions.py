"""Numbered versions in a folder: small JSON documents that are created once and never changed."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Versions:
    """Which version is current, and what it says. The folder may be anything that Spark's file system layer opens.

    A number is created, never overwritten, so of two writers of one number one fails; a document that a writer did not
    finish does not parse and is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(conf), path

    def numbers(self) -> list[int]:
        fs, path = self._fs()
        root = path(self.folder)
        if not fs.exists(root):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit())

    def get(self, number: int) -> dict | None:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.folder}/{number}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The last number that was taken, and the last document that is whole."""
        numbers = self.numbers()
        for n in reversed(numbers):
            if (content := self.get(n)) is not None:
                return numbers[-1], content
        return (numbers[-1] if numbers else 0), None

    def put(self, number: int, content: dict) -> None:
        fs, path = self._fs()
        try:
            stream = fs.create(path(f"{self.folder}/{number}"), False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception):
                raise OSError(f"version {number} of {self.folder} was written by someone else") from None
            raise
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()

    def drop(self, folders: list[str], numbers: list[int]) -> None:
        """Deletes folders, then the documents of these numbers."""
        fs, path = self._fs()
        for f in folders:
            fs.delete(path(f), True)
        for n in numbers:
            fs.delete(path(f"{self.folder}/{n}"), False)
