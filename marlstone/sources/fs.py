"""Files on whatever file system Spark reads and writes, through Hadoop's classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength())

    def chunks(self, path: str, size: int = 1 << 16) -> Iterator[bytes]:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            while data := bytes(stream.readNBytes(size)):
                yield data
        finally:
            stream.close()

    def part(self, path: str, start: int, end: int) -> bytes:
        """Bytes from ``start`` up to ``end``."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            stream.seek(start)
            out = bytearray()
            while len(out) < end - start and (data := bytes(stream.readNBytes(min(end - start - len(out), 1 << 20)))):
                out += data
            return bytes(out)
        finally:
            stream.close()

    def read(self, path: str) -> bytes:
        return b"".join(self.chunks(path, 1 << 20))

    def join(self, path: str, parts: list[str], head: bytes = b"") -> None:
        """A new file of ``head`` and the bytes of ``parts``, copied a megabyte at a time."""
        fs, p = self._at(path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(head))
            for part in parts:
                source, q = self._at(part)
                stream = source.open(q)
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def replace(self, path: str, data: bytes) -> None:
        """Writes a file whole: under another name first, then renamed over the old one."""
        draft = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._at(draft)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(p, self._jvm.org.apache.hadoop.fs.Path(path), options)


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and all runs on one machine (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/marlstone-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="marlstone-")
