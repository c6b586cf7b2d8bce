"""Files in any store that Spark reads, through Hadoop's file systems; used for metadata on the driver only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession

PIECE = 1 << 18


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(uri)

    def system(self, uri: str):
        fs = self.path(uri).getFileSystem(self.conf)
        fs.setWriteChecksum(False)  # no .crc files beside contractual names
        return fs

    def exists(self, uri: str) -> bool:
        return self.system(uri).exists(self.path(uri))

    def make(self, uri: str) -> None:
        self.system(uri).mkdirs(self.path(uri))

    def delete(self, uri: str) -> None:
        """Absent is fine; a failed deletion raises."""
        fs = self.system(uri)
        if fs.exists(self.path(uri)) and not fs.delete(self.path(uri), True):
            raise OSError(f"could not delete {uri}")

    def move(self, source: str, target: str) -> None:
        """Replaces a file; never nests a folder in an existing one."""
        self._rename(source, target, "OVERWRITE")

    def _rename(self, source: str, target: str, how: str) -> None:
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, how)
        qualified = self.system(source).makeQualified(self.path(source))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.conf).rename(qualified, self.system(target).makeQualified(self.path(target)), options)

    def walk(self, uri: str) -> list[str]:
        """All files below, sorted."""
        if not self.exists(uri):
            return []
        found, files = [], self.system(uri).listFiles(self.path(uri), True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
        return sorted(found)

    def names(self, uri: str) -> list[tuple[str, bool, int]]:
        """(name, is it a folder, bytes) of what lies directly in a folder, sorted."""
        if not self.exists(uri):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self.system(uri).listStatus(self.path(uri)))

    def read(self, uri: str) -> str:
        stream = self.system(uri).open(self.path(uri))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, uri: str, text: str) -> None:
        """Whole or not at all: written beside, then moved over."""
        self._write(uri, [text])

    def write_lines(self, uri: str, lines: Iterable[str]) -> None:
        """The same, a line at a time, of which some ``PIECE`` characters are held."""

        def pieces() -> Iterator[str]:
            held, size = [], 0
            for line in lines:
                held.append(line + "\n")
                size += len(line)
                if size > PIECE:
                    yield "".join(held)
                    held, size = [], 0
            yield "".join(held)

        self._write(uri, pieces())

    def _write(self, uri: str, pieces: Iterable[str]) -> None:
        beside = f"{uri}.{uuid.uuid4().hex}.tmp"
        stream = self.system(uri).create(self.path(beside), True)
        try:
            for piece in pieces:
                stream.write(piece.encode())
        except BaseException:
            stream.close()
            self.delete(beside)
            raise
        stream.close()
        self.move(beside, uri)

    def create(self, uri: str, text: str) -> bool:
        """A new file, whole or not at all; False if there is one already."""
        beside = f"{uri}.{uuid.uuid4().hex}.tmp"
        stream = self.system(uri).create(self.path(beside), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            self._rename(beside, uri, "NONE")
            return True
        except Exception:
            if not self.exists(uri):
                raise
            return False
        finally:
            self.delete(beside)

    def write_json(self, uri: str, value: dict[str, Any]) -> None:
        self.write(uri, json.dumps(value, indent=2, sort_keys=True))
