"""A log of numbered entries in a shared folder: an entry is published whole, or not at all if another has its number."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from corvane.scratch import delete, file_system


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entry(self, number: int) -> str:
        return f"{self.path}/{number:012d}"

    def numbers(self) -> list[int]:
        files, at = file_system(self.spark, self.path)
        return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()) if files.exists(at) else []

    def read(self, number: int) -> str:
        return self.spark.read.text(self._entry(number), wholetext=True).first()["value"]

    def last(self) -> tuple[int, str | None]:
        """(number, text) of the newest entry; (-1, None) without one."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def publish(self, number: int, text: str) -> bool:
        """False if the number is taken: the file is written beside the log's entries and renamed, which never replaces one."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        files, unfinished = file_system(self.spark, f"{self.path}/_{uuid.uuid4().hex}")
        stream = files.create(unfinished, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(unfinished), files.makeQualified(hadoop.Path(self._entry(number))), options)
        except Py4JJavaError as e:
            files.delete(unfinished, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def forget(self, before: int) -> None:
        """Delete entries with lower numbers."""
        for number in self.numbers():
            if number < before:
                delete(self.spark, self._entry(number))
