"""Numbered states of a stored table.

A state is one small JSON text that names the folders it is made of. It exists once it is written to its end, so a writer
that dies leaves the table as it was, and of two writers of one number the later is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer has committed this number."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, number: int) -> str:
        return f"{self.root}/states/{number:08d}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def numbers(self) -> list[int]:
        """All states that are complete, oldest first."""
        fs, where = self._fs(f"{self.root}/states/*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName()) for f in fs.globStatus(where) or [])

    def newest(self) -> int:
        """-1 where there is none."""
        return max(self.numbers(), default=-1)

    def read(self, number: int | None = None) -> dict:
        number = self.newest() if number is None else number
        return json.loads(self.spark.read.text(self._folder(number), wholetext=True).first()[0])

    def commit(self, number: int, state: dict) -> None:
        if number in self.numbers():
            raise VersionTaken(f"state {number} of {self.root} is written already")
        one = self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1)
        one.write.mode("overwrite").text(self._folder(number))

    def drop(self, *folders: str) -> None:
        """Delete folders below the table's own."""
        for folder in folders:
            fs, where = self._fs(f"{self.root}/{folder}")
            fs.delete(where, True)

    def forget(self, keep: int, folders) -> list[str]:
        """Delete all but the last ``keep`` states, and what ``folders(state)`` names for none of those kept."""
        numbers = self.numbers()
        old, kept = numbers[: max(0, len(numbers) - max(1, keep))], numbers[-max(1, keep) :]
        held = {f for n in kept for f in folders(self.read(n))}
        gone = sorted({f for n in old for f in folders(self.read(n))} - held)
        # States first: what they name must not be missing while they can be read.
        self.drop(*[f"states/{n:08d}" for n in old], *gone)
        return gone
