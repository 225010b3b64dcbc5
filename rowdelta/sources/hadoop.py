"""Files of any file system that Spark reaches, seen from the driver."""

from __future__ import annotations

import io

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder in name order without hidden ones. None: no such path."""
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return []
    found = []
    each = fs.listFiles(where, True)
    root = fs.makeQualified(where).toString().rstrip("/")
    while each.hasNext():
        status = each.next()
        name = status.getPath().toString()
        inside = name[len(root) :].lstrip("/").split("/") if name != root else []
        if not any(part[0] == "." or (part[0] == "_" and "=" not in part) for part in inside):
            found.append((name, status.getLen()))
    return sorted(found)


class HadoopFile(io.RawIOBase):
    """A file opened by Hadoop, for readers that seek: footers are read without the rest."""

    def __init__(self, spark: SparkSession, path: str):
        where, fs = file_system(spark, path)
        self.size = fs.getFileStatus(where).getLen()
        self._in, self._at = fs.open(where), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self.size}[whence]
        return self._at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self._at if n is None or n < 0 else max(0, min(n, self.size - self._at))
        if not n:
            return b""
        self._in.seek(self._at)
        self._at += n
        return bytes(self._in.readNBytes(n))

    def readinto(self, into) -> int:
        got = self.read(len(into))
        into[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self._in.close()
        super().close()
